"""Sampling documents so that sources, languages and topics get target weights.

Iterative proportional fitting rakes the token weights of the (source,
language, topic) cells until all three marginals are met; a document is then
kept with its cell's calibrated probability.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.session import discard, materialize, private_name

NONE = "(none)"
#: Topics by the first rule that holds for the text in lower case; the rest is general. A rule holds if the text has one
#: of the literals, or has a sign and matches the pattern with it. Literals are found far faster than patterns.
TOPICS = (
    ("legal", ("license ", "licence ", "licensed ", "licenced ", "copyright", "all rights reserved"), ()),
    ("tabular", (), ((" | ", r" \| .* \| "),)),
    ("technical", ("<secret>", "<ip>", "http://", "https://"), ((" = ", r"""[a-z_]{2,} = ["'0-9\[{(]"""), (".", r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"))),
    ("contact", ("<email>", "<phone>"), (("@", r"[a-z0-9]@[a-z0-9]"), ("+", r"\+[0-9]{1,3}[ (.-]+[0-9]{2}"))),
)


@dataclass(frozen=True)
class MixParams:
    """Targets are shares by value; where none is given, the corpus's own shares to the power ``temper``, so that large sources shrink and small ones grow."""

    dims: tuple[str, ...] = ("source", "lang", "topic")
    targets: dict[str, dict[str, float]] = field(default_factory=dict, hash=False)
    temper: float = 0.7
    fraction: float = 0.8
    bounded: bool = True  # the sample itself meets the targets; else only with mix_weight
    rounds: int = 100  # of raking, with weights cut at a cell's tokens if bounded
    settle_rounds: int = 50  # and then without the cut
    driver_cells: int = 1_000_000
    broadcast_cells: int = 100_000


def topic(text: Column) -> Column:
    out = F.lit("general")
    for name, literals, patterns in reversed(TOPICS):
        tests = [text.contains(x) for x in literals] + [text.contains(sign) & text.rlike(pattern) for sign, pattern in patterns]
        out = F.when(reduce(lambda a, b: a | b, tests), F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Pieces between single spaces; a null or blank text has none."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A fixed number in [0, 1) from the id; without one, from the text."""
    seed = F.md5(F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))
    return F.conv(F.substring(seed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def tempered(mass: pd.Series, temper: float) -> pd.Series:
    x = (mass / mass.sum()) ** temper
    return x / x.sum()


def target_shares(cells: pd.DataFrame, p: MixParams) -> dict[str, pd.Series]:
    """For each dimension the share of each value that occurs; given targets are scaled to those, values they leave out get nothing."""
    out = {}
    for d in p.dims:
        mass = cells.groupby(d)["tokens"].sum()
        if d in p.targets:
            x = pd.Series(p.targets[d], dtype="float64").reindex(mass.index).fillna(0.0)
            if x.sum() <= 0:
                raise ValueError(f"no target of {d} names a value that occurs")
            out[d] = x / x.sum()
        else:
            out[d] = tempered(mass, p.temper)
    return out


def rake(cells: pd.DataFrame, shares: dict[str, pd.Series], rounds: int) -> np.ndarray:
    """Cell weights with the cells' total that come as near to all marginals as ``rounds`` rounds bring them."""
    w = cells["tokens"].to_numpy(np.float64).copy()
    total = w.sum()
    for _ in range(rounds):
        for d, share in shares.items():
            code, values = pd.factorize(cells[d])
            now = np.bincount(code, w, len(values))
            want = share.reindex(values).to_numpy() * total
            w *= np.divide(want, now, out=np.zeros_like(now), where=now > 0)[code]
    return w


def widest(trial: Callable[[float], tuple[object, float]], most: float, tries: int) -> object:
    """The weights of the trial that keeps the most. ``trial`` takes tokens to aim at and gives weights and the tokens that they keep."""
    best, kept = trial(most)
    high = most
    for _ in range(tries):
        if kept >= 0.99 * high:
            break
        aim = math.sqrt(kept * high)
        w, got = trial(aim)
        if got < 0.99 * aim:
            high = aim
        if got > kept:
            best, kept = w, got
    return best


def warn_of_gap(gap: float) -> None:
    if gap > 1e-3:
        warnings.warn(f"no sample of these documents was found that meets all targets; a share is off by {gap:.4f}", stacklevel=3)


def marginal_gap(cells: pd.DataFrame, w: np.ndarray, shares: dict[str, pd.Series]) -> float:
    """The largest difference between a share of ``w`` and its target."""
    return max(float((pd.Series(w).groupby(cells[d].to_numpy()).sum() / w.sum() - share).abs().max()) for d, share in shares.items())


def rake_bounded(cells: pd.DataFrame, shares: dict[str, pd.Series], p: MixParams, tries: int = 12) -> np.ndarray:
    """Cell weights, none above the cell's tokens, that meet the marginals with as much of ``fraction`` of the tokens as is found possible.

    Rounds that cut weights at the cell's tokens move the excess to other
    cells; rounds without the cut then settle the marginals, and what is still
    above a cell's tokens is settled by lowering all weights alike.
    """
    t = cells["tokens"].to_numpy(np.float64)
    codes = {d: pd.factorize(cells[d]) for d in shares}
    want = {d: shares[d].reindex(codes[d][1]).to_numpy() for d in shares}

    def trial(total: float) -> tuple[np.ndarray, float]:
        w = t * (total / t.sum())
        for cut, n in ((True, p.rounds), (False, p.settle_rounds)):
            for _ in range(n):
                for d in shares:
                    code, values = codes[d]
                    now = np.bincount(code, w, len(values))
                    w = w * np.divide(want[d] * total, now, out=np.zeros_like(now), where=now > 0)[code]
                if cut:
                    w = np.minimum(w, t)
        w = w / max(1.0, float((w / t).max()))
        return w, float(w.sum())

    room = [np.bincount(codes[d][0], t)[want[d] > 0] / want[d][want[d] > 0] for d in shares]
    w = widest(trial, min(p.fraction * float(t.sum()), *(float(x.min()) for x in room)), tries)
    warn_of_gap(marginal_gap(cells, w, shares))
    return w


def rake_frames(cells: DataFrame, p: MixParams) -> DataFrame:
    """``rake`` or ``rake_bounded`` without the driver, for more cells than it should hold; each round is written to the shared folder."""
    total = float(cells.agg(F.sum("tokens")).first()[0])
    want = {}
    for d in p.dims:
        mass = cells.groupBy(d).agg(F.sum("tokens").alias("m"))
        if d in p.targets:
            known = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in p.targets[d].items()], f"`{d}` string, x double")
            mass = mass.join(known, d, "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
        else:
            mass = mass.withColumn("x", F.pow(F.col("m") / F.lit(total), F.lit(p.temper)))
        whole = mass.agg(F.sum("x")).first()[0]
        if not whole:
            raise ValueError(f"no target of {d} names a value that occurs")
        want[d] = mass.select(d, "m", (F.col("x") / F.lit(whole) * F.lit(total)).alias("want"))

    def rounds(held: DataFrame, n: int, aim: float, cut: bool = False, close: float | None = None) -> DataFrame:
        before = None
        for _ in range(n):
            held = held.withColumn("w0", F.col("w"))
            for d in p.dims:
                scale = held.groupBy(d).agg(F.sum("w").alias("now")).join(want[d], d).select(d, F.when(F.col("now") > 0, F.col("want") * F.lit(aim / total) / F.col("now")).otherwise(0.0).alias("by"))
                held = held.join(scale, d).withColumn("w", F.col("w") * F.col("by")).drop("by")
            if cut:
                held = held.withColumn("w", F.least("w", F.col("tokens").cast("double")))
            held = materialize(held, "rake-round")
            if before is not None:
                discard(before)
            before = held
            moved = held.agg(F.max(F.abs(F.col("w") - F.col("w0")))).first()[0] if close is not None else None
            held = held.drop("w0")
            if moved is not None and moved <= close * aim:
                break
        return held

    start = cells.withColumn("w", F.col("tokens").cast("double"))
    if not p.bounded:
        return rounds(start, p.rounds, total, close=1e-9)

    def trial(aim: float) -> tuple[DataFrame, float]:
        held = rounds(start.withColumn("w", F.col("w") * F.lit(aim / total)), p.rounds, aim, cut=True, close=1e-6)
        held = rounds(held, p.settle_rounds, aim, close=1e-6)
        most, kept = held.agg(F.max(F.col("w") / F.col("tokens")), F.sum("w")).first()
        return held.withColumn("w", F.col("w") / F.lit(max(1.0, most))), kept / max(1.0, most)

    room = min(want[d].filter("want > 0").agg(F.min(F.col("m") / F.col("want"))).first()[0] for d in p.dims)
    held = widest(trial, min(p.fraction, room) * total, 3)
    kept = held.agg(F.sum("w")).first()[0]
    gap = max(held.groupBy(d).agg(F.sum("w").alias("now")).join(want[d], d).agg(F.max(F.abs(F.col("now") / F.lit(kept) - F.col("want") / F.lit(total)))).first()[0] for d in p.dims)
    warn_of_gap(gap)
    return held


def mix_sources(docs: DataFrame, params: MixParams = MixParams(), text: str = "text", doc_id: str = "doc_id", weights: bool = False) -> DataFrame:
    """A sample of ``docs`` with target weights; with ``weights`` also topic, keep_probability and mix_weight.

    A cell's probability is its raked weight over its tokens. No weight is
    raked above the tokens that are there, and ``fraction`` is lowered as far
    as that takes: the sample itself is expected to meet the marginals, and
    mix_weight is 1. If no sample can meet them all, a warning says by how
    much it misses. Without ``bounded``, probabilities are cut at 1, and
    mix_weight is what that left over, so that tokens times mix_weight meet
    the marginals.

    Whether a document stays depends on its id alone, so repeated rows stay or
    go together; without an id, on its text. A null source or language is a
    value of its own, ``(none)``. A null or blank text has no tokens, weighs
    nothing and stays as its cell's other texts do; a cell with no token in it
    is kept. Texts are counted whole. Other columns are passed on, and an
    empty table gives an empty table. Does ``docs`` have a column topic, that
    is the topic.
    """
    p = params
    names = list(docs.columns)
    key = {}
    staged = docs
    for d in p.dims:
        key[d] = private_name(staged, f"__mix_{d}")
        if d == "topic" and d not in names:
            low = private_name(staged, "__mix_low")
            staged = staged.withColumn(low, F.explode(F.array(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))))))  # once, not once for each literal
            value = topic(F.col(low))
        else:
            value = F.col(f"`{d}`").cast("string")
        staged = staged.withColumn(key[d], F.coalesce(value, F.lit(NONE)))
    counted = staged.select(*[F.col(key[d]).alias(d) for d in p.dims], tokens(F.col(f"`{text}`")).alias("tokens"))
    cells = materialize(counted.groupBy(*p.dims).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    n = cells.count()
    if n <= p.driver_cells:
        pdf = cells.toPandas().sort_values(list(p.dims), ignore_index=True)
        full = pdf[pdf["tokens"] > 0].reset_index(drop=True)
        if len(full):
            shares = target_shares(full, p)
            full["w"] = rake_bounded(full, shares, p) / p.fraction if p.bounded else rake(full, shares, p.rounds)
        ratio = {} if not len(full) else dict(zip(full[list(p.dims)].itertuples(index=False, name=None), (full["w"] / full["tokens"]).tolist()))
        rows = [(*c, float(ratio.get(c, 1.0 / p.fraction))) for c in pdf[list(p.dims)].itertuples(index=False, name=None)]
        factors = docs.sparkSession.createDataFrame(rows, ", ".join(f"`{key[d]}` string" for d in p.dims) + ", __mix_factor double")
    else:
        raked = rake_frames(cells.filter("tokens > 0"), p).select(*p.dims, (F.col("w") / F.lit(p.fraction if p.bounded else 1.0) / F.col("tokens")).alias("__mix_factor"))
        blank = cells.filter("tokens = 0").select(*p.dims, F.lit(1.0 / p.fraction).alias("__mix_factor"))
        factors = raked.unionByName(blank).select(*[F.col(d).alias(key[d]) for d in p.dims], "__mix_factor")
    if n <= p.broadcast_cells:
        factors = F.broadcast(factors)
    factor = private_name(staged, "__mix_factor")
    factors = factors.withColumnRenamed("__mix_factor", factor)
    chance = F.least(F.lit(1.0), F.col(factor) * F.lit(p.fraction))
    out = staged.join(factors, list(key.values())).filter(uniform(F.col(f"`{doc_id}`"), F.col(f"`{text}`")) < chance)
    cols = [F.col(f"`{c}`") for c in names]
    if weights:
        extra = [] if "topic" in names else [F.col(key["topic"]).alias("topic")] if "topic" in key else []
        cols += extra + [chance.alias("keep_probability"), F.when(F.col(factor) > 0, F.col(factor) * F.lit(p.fraction) / chance).otherwise(0.0).alias("mix_weight")]
    return out.select(*cols)


def mix_sources_sql(p: MixParams = MixParams()) -> str:
    """The same for DuckDB over documents, with tempered targets and one trial, which is enough where the targets can be met."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    holds = lambda lits, patterns: " OR ".join([f"contains(lower(text), {q(x)})" for x in lits] + [f"regexp_matches(lower(text), {q(x)})" for _, x in patterns])
    rules = " ".join(f"WHEN {holds(lits, patterns)} THEN '{name}'" for name, lits, patterns in TOPICS)
    keys = [f"k_{d}" for d in p.dims]
    cell = ", ".join(keys)
    ctes = [
        f"""staged AS (SELECT *, coalesce(source, '{NONE}') AS k_source, coalesce(lang, '{NONE}') AS k_lang, CASE {rules} ELSE 'general' END AS k_topic,
        CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT k_source, k_lang, k_topic, sum(tokens)::DOUBLE AS tokens FROM staged GROUP BY ALL)",
        "r0 AS MATERIALIZED (SELECT * FROM cells WHERE tokens > 0)",
        "whole AS MATERIALIZED (SELECT sum(tokens) AS tokens FROM r0)",
    ]
    for k in keys:
        ctes.append(f"m_{k} AS MATERIALIZED (SELECT {k}, sum(tokens) AS mass, pow(sum(tokens) / (SELECT tokens FROM whole), {p.temper}) AS x FROM r0 GROUP BY {k})")
        ctes.append(f"s_{k} AS MATERIALIZED (SELECT {k}, mass, x / (SELECT sum(x) FROM m_{k}) AS share_{k} FROM m_{k})")
    rooms = ", ".join(f"(SELECT min(mass / share_{k}) FROM s_{k})" for k in keys)
    ctes.append(f"aim AS MATERIALIZED (SELECT least({p.fraction} * tokens, {rooms}) AS total, tokens FROM whole)")
    joins = " ".join(f"JOIN s_{k} USING ({k})" for k in keys)
    shares = ", ".join(f"share_{k}" for k in keys)
    inner = f"SELECT * FROM raked WHERE step < {p.rounds + p.settle_rounds}"
    for k in keys:
        inner = f"SELECT * REPLACE (w * share_{k} * total / sum(w) OVER (PARTITION BY {k}) AS w) FROM ({inner})"
    ctes.append(f"""raked AS (SELECT 0 AS step, {cell}, r0.tokens, {shares}, aim.total, r0.tokens * aim.total / aim.tokens AS w FROM r0 {joins} CROSS JOIN aim
      UNION ALL SELECT step + 1, {cell}, tokens, {shares}, total, CASE WHEN step < {p.rounds} THEN least(w, tokens) ELSE w END FROM ({inner}))""")
    ctes.append(f"settled AS MATERIALIZED (SELECT {cell}, w / tokens / greatest(1.0, (SELECT max(w / tokens) FROM raked WHERE step = {p.rounds + p.settle_rounds})) AS chance FROM raked WHERE step = {p.rounds + p.settle_rounds})")
    ctes.append(f"f AS (SELECT {cell}, least(1.0, coalesce(chance, 1.0)) AS chance FROM cells LEFT JOIN settled USING ({cell}))")
    return f"""WITH RECURSIVE {", ".join(ctes)}
    SELECT doc_id, text, lang, source, n_chars, k_topic AS topic, round(chance, 6) AS keep_probability, 1.0::DOUBLE AS mix_weight FROM staged JOIN f USING ({cell})
    WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT / {float(1 << 52)} < chance"""
