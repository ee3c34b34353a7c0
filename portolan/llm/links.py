"""URL filtering by what hosts link to.

Trust flows from trusted seeds along the links between hosts, distrust from
blocked seeds against them; both are personalised PageRank on the host graph.
A page goes or stays with its host's two scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.session import discard, materialize, private_name, ship_code

HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]+)"
LINK = r"""<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["']?\s*((?:[hH][tT][tT][pP][sS]?:)?//[^/"'\s>?#]+)"""
VARIANT = r"^(?:www[0-9]?|m|mobile|amp|blog)\."


@dataclass(frozen=True)
class LinkParams:
    """A seed starts with 1 - damping; scores are in that unit, so thresholds mean the same for every number of hosts and seeds."""

    trusted: str = r"\.(?:edu|gov|org)$"
    blocked: str = r"(?:^|[.-])(?:casino|pills|bets|spam|adult|porn|ads|track|warez|malware)(?:[.-]|$)"
    damping: float = 0.85
    rounds: int = 60  # what is then still to come is at most damping^61 / (1 - damping) = 0.0003 of a seed's unit
    settled: float = 1e-9  # rounds end when no score moves by more
    save_every: int = 5
    local_links: int = 1_000_000  # links that one task scores by itself
    max_distrust: float = 0.1
    trust_weight: float = 1.0
    broadcast_hosts: int = 200_000


def host_of(url: Column) -> Column:
    """The host in lower case without a port, user or final dot; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) of different hosts where a page of src links to dst."""
    p = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.col(f"`{html}`").alias("h")).filter("src is not null")
    links = p.select("src", F.explode(F.array_distinct(F.regexp_extract_all("h", F.lit(LINK), F.lit(1)))).alias("to")).select("src", host_of(F.col("to")).alias("dst"))
    return links.filter("dst is not null and src != dst").distinct()


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst): the links, and between a host and its name without www, mobile or blog, both ways."""
    bare = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", VARIANT, "").alias("dst")).filter(F.col("src") != F.col("dst"))
    return links.unionAll(bare).unionAll(bare.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _ranked(flows: pd.DataFrame, seeds: pd.DataFrame, p: LinkParams) -> pd.DataFrame:
    """(kind, host, score) of one kind, by products with the links' matrix."""
    code, hosts = pd.factorize(pd.concat([flows["src"], flows["dst"], seeds["host"]], ignore_index=True))
    n = len(flows)
    src, dst, part = code[:n], code[n : 2 * n], flows["part"].to_numpy(np.float64)
    start = np.bincount(code[2 * n :], seeds["score"], len(hosts))
    score = start
    for _ in range(p.rounds):
        new = start + np.bincount(dst, score[src] * part, len(hosts))
        moved = np.abs(new - score).max()
        score = new
        if moved <= p.settled:
            break
    some = np.flatnonzero(score > 0)
    return pd.DataFrame({"kind": seeds["kind"].iloc[0], "host": np.asarray(hosts)[some], "score": score[some]})


def host_scores(edges: DataFrame, seeds: DataFrame, p: LinkParams) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds, or fewer once no score moves, in units of a seed's own share.

    ``seeds``: (kind, host) with kind 0 for trusted and 1 for blocked. What
    reaches a host without further links ends there. Up to ``local_links``
    links are scored by one task for each kind, more of them by joins; the
    scores are the same.
    """
    ship_code(edges.sparkSession)
    unit = 1.0 - p.damping
    both = edges.select(F.lit(0).alias("kind"), "src", "dst").unionAll(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("n"))
    flows = materialize(both.join(degree, ["kind", "src"]).select("kind", "src", "dst", (F.lit(p.damping) / F.col("n")).alias("part")), "link-flows")
    start = materialize(seeds.select("kind", "host", F.lit(unit).alias("score")), "link-seeds")
    if flows.count() <= 2 * p.local_links and start.count() <= p.local_links:
        both_sides = flows.groupBy("kind").cogroup(start.groupBy("kind"))
        score = both_sides.applyInPandas(lambda f, s: _ranked(f, s, p) if len(s) else s, "kind int, host string, score double")
    else:
        score, saved = start, None
        for k in range(p.rounds):
            moved = flows.join(score.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("part")).alias("score"))
            before, score = score, moved.unionAll(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if (k + 1) % p.save_every == 0:
                old = before.withColumnRenamed("score", "old")
                score = materialize(score.join(old, ["kind", "host"], "left").withColumn("by", F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))).drop("old"), "link-scores")
                if saved is not None:
                    discard(saved)
                saved = score
                by = score.agg(F.max("by")).first()[0]
                score = score.drop("by")
                if by is None or by <= p.settled:
                    break
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)) / F.lit(unit)
    return score.groupBy("host").agg(one(0).alias("trust"), one(1).alias("distrust"))


def filter_urls(pages: DataFrame, params: LinkParams = LinkParams(), url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with host, trust, distrust and kept.

    A host's pages go if its distrust is above ``max_distrust`` and above
    ``trust_weight`` times its trust; a blocked seed's always go. A host that
    no score reaches stays.

    A url without a host, empty or null gives a null host, no scores, and
    stays; a null page has no links. Repeated pages count their links once and
    are each judged alike. Columns that are called like the new ones are
    replaced, others passed on; an empty table gives an empty table.
    """
    p = params
    links = materialize(page_links(pages, url, html), "host-links")  # the one look at the pages themselves
    own = materialize(pages.select(host_of(F.col(f"`{url}`")).alias("host")).filter("host is not null").distinct(), "page-hosts")
    edges = materialize(host_edges(links, own.unionAll(links.select("src")).unionAll(links.select("dst")).distinct()), "host-edges")
    hosts = own.unionAll(edges.select("src")).unionAll(edges.select("dst")).distinct()
    bad = F.col("host").rlike(p.blocked)
    seeds = hosts.select(F.when(bad, 1).when(F.col("host").rlike(p.trusted), 0).alias("kind"), "host").filter("kind is not null")
    scores = host_scores(edges, seeds, p).join(own, "host", "left_semi")
    scores = materialize(own.join(scores, "host", "left"), "host-scores")
    if scores.count() <= p.broadcast_hosts:
        scores = F.broadcast(scores)
    key = private_name(pages, "__host")
    left = pages.drop(html, *[c for c in ("host", "trust", "distrust", "kept") if c != url]).withColumn(key, host_of(F.col(f"`{url}`")))
    joined = left.join(scores.withColumnRenamed("host", key), key, "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    gone = F.coalesce(F.col(key).rlike(p.blocked), F.lit(False)) | ((distrust > p.max_distrust) & (distrust > trust * F.lit(p.trust_weight)))
    names = [c for c in left.columns if c != key]
    return joined.select(*[F.col(f"`{c}`") for c in names], F.col(key).alias("host"), trust.alias("trust"), distrust.alias("distrust"), (~gone).alias("kept"))


def filter_urls_sql(p: LinkParams = LinkParams()) -> str:
    """The same for DuckDB; scores are rounded to 6 places."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    host = lambda c: f"nullif(regexp_replace(lower(regexp_extract({c}, {q(HOST)}, 1)), '\\.$', ''), '')"
    unit = 1.0 - p.damping
    ctes = [
        f"p AS (SELECT {host('url')} AS src, html FROM pages)",
        f"links AS (SELECT DISTINCT src, {host('l')} AS dst FROM (SELECT src, unnest(regexp_extract_all(html, {q(LINK)}, 1)) AS l FROM p WHERE src IS NOT NULL))",
        "seen AS (SELECT src, dst FROM links WHERE dst IS NOT NULL AND src <> dst)",
        "hosts AS (SELECT DISTINCT src FROM p WHERE src IS NOT NULL UNION SELECT dst FROM seen)",
        f"bare AS (SELECT src, regexp_replace(src, {q(VARIANT)}, '') AS dst FROM hosts WHERE regexp_matches(src, {q(VARIANT)}))",
        "edges AS (SELECT * FROM seen UNION SELECT * FROM bare UNION SELECT dst, src FROM bare)",
        "nodes AS (SELECT src AS host FROM hosts UNION SELECT dst FROM edges)",
        f"seeds AS MATERIALIZED (SELECT CASE WHEN regexp_matches(host, {q(p.blocked)}) THEN 1 WHEN regexp_matches(host, {q(p.trusted)}) THEN 0 END AS kind, host, {unit}::DOUBLE AS score FROM nodes)",
        "s0 AS MATERIALIZED (SELECT * FROM seeds WHERE kind IS NOT NULL)",
        "flow AS (SELECT 0 AS kind, src, dst FROM edges UNION ALL SELECT 1, dst, src FROM edges)",
        f"flows AS MATERIALIZED (SELECT *, {p.damping}::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS part FROM flow)",
    ]
    step = "SELECT f.kind, f.dst AS host, s.score * f.part AS score, s.step FROM flows f JOIN rounds s ON f.kind = s.kind AND f.src = s.host"
    again = "SELECT s0.kind, s0.host, s0.score, r.step FROM s0 CROSS JOIN (SELECT max(step) AS step FROM rounds) r WHERE r.step IS NOT NULL"
    ctes.append(f"rounds AS (SELECT 0 AS step, kind, host, score FROM s0 UNION ALL SELECT any_value(step) + 1, kind, host, sum(score) FROM ({step} UNION ALL {again}) WHERE step < {p.rounds} GROUP BY kind, host)")
    ctes.append(f"final AS (SELECT host, sum(CASE WHEN kind = 0 THEN score ELSE 0 END) / {unit} AS trust, sum(CASE WHEN kind = 1 THEN score ELSE 0 END) / {unit} AS distrust FROM rounds WHERE step = {p.rounds} GROUP BY host)")
    return f"""WITH RECURSIVE {", ".join(ctes)}
    SELECT page_id, url, {host("url")} AS host, round(coalesce(trust, 0.0), 6) AS trust, round(coalesce(distrust, 0.0), 6) AS distrust,
      NOT (coalesce(regexp_matches({host("url")}, {q(p.blocked)}), false) OR (coalesce(distrust, 0) > {p.max_distrust} AND coalesce(distrust, 0) > coalesce(trust, 0) * {p.trust_weight})) AS kept
    FROM pages LEFT JOIN final f ON f.host = {host("url")}"""
