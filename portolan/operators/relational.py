"""Operators that Spark's SQL doesn't have under one name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portolan.session import materialize, private_name


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, which should be total; null keys are a group. Planned as a per-group limit before the shuffle's window."""
    rn = private_name(df, "__rn")
    return df.withColumn(rn, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rn) <= n).drop(rn)


def _comparable(df: DataFrame, skip: Sequence[str]) -> list[str]:
    bad = ("map", "variant")
    return [f.name for f in df.schema.fields if f.name not in skip and f.dataType.typeName() not in bad]


def latest_by(df: DataFrame, keys: Sequence[str], by: str, nulls_first: bool = True) -> DataFrame:
    """The latest row of each group. Nulls count as latest by default; ties go to the least of the other columns, so that a rerun picks the same row."""
    first = F.col(by).desc_nulls_first() if nulls_first else F.col(by).desc_nulls_last()
    return top_by(df, keys, [first, *[F.col(f"`{c}`").asc_nulls_last() for c in _comparable(df, [*keys, by])]])


def mode_by(df: DataFrame, keys: Sequence[str], values: Sequence[str], count: str = "n", weight: str | None = None) -> DataFrame:
    """The most frequent combination of ``values`` in each group, with its count (or sum of ``weight``); ties go to the least, nulls last."""
    n = F.count("*") if weight is None else F.sum(weight)
    counted = df.groupBy(*keys, *values).agg(n.alias(count))
    return top_by(counted, keys, [F.col(count).desc_nulls_last(), *[F.col(v).asc_nulls_last() for v in values]])


def shortest_by(df: DataFrame, key: str, text: str, tie: str) -> DataFrame:
    """The shortest text that isn't blank for each key: (key, text). Ties go to the least ``tie``."""
    have = df.filter(F.col(key).isNotNull() & (F.trim(text) != ""))
    return top_by(have, [key], [F.length(text).asc(), F.col(tie).asc_nulls_last(), F.col(text).asc()]).select(key, text)


def with_shares(df: DataFrame, keys: Sequence[str], holder: Sequence[str], weight: str | None = None) -> DataFrame:
    """Each holder's share of its group's rows, or of the sum of ``weight``; one aggregation and one window over its result."""
    n = F.count("*") if weight is None else F.sum(weight)
    by = df.groupBy(*keys, *holder).agg(n.cast("double").alias("__n"))
    return by.withColumn("share", F.col("__n") / F.nullif(F.sum("__n").over(W.partitionBy(*keys)), F.lit(0.0))).drop("__n")


def hhi(df: DataFrame, keys: Sequence[str], holder: Sequence[str], weight: str | None = None, name: str = "hhi", top: str = "top_share") -> DataFrame:
    """The Herfindahl-Hirschman index of each group over its holders, 0 to 1, and the largest share."""
    s = with_shares(df, keys, holder, weight)
    return s.groupBy(*keys).agg(F.sum(F.col("share") * F.col("share")).alias(name), F.max("share").alias(top))


def count_distinct_over(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the number of distinct values in the row's group, as a window function would give it. A group's distinct values are in memory once, not once for each row."""
    counts = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.countDistinct(value).alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = df.join(counts, on, "left")
    return joined.drop(*[f"__k_{k}" for k in keys])


def disjunctive_pairs(df: DataFrame, row_id: str, left_key: str, right_key: str) -> DataFrame:
    """Pairs (a, b) of rows with id a < id b that agree in one key or the other: two equi-joins, the second without what the first has.

    As a single OR the join would compare all rows with all. Columns: those of
    ``df`` twice, with suffixes _a and _b.
    """
    a = df.select(*[F.col(c).alias(f"{c}_a") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"{c}_b") for c in df.columns])
    less = F.col(f"{row_id}_a") < F.col(f"{row_id}_b")
    same = lambda k: F.col(f"{k}_a") == F.col(f"{k}_b")
    first = a.join(b, same(left_key) & less)
    second = a.join(b, same(right_key) & less & ~F.coalesce(same(left_key), F.lit(False)))
    return first.unionByName(second)


def blocking_pairs(df: DataFrame, key: str, name: str, max_length_gap: int = 20, keep: Sequence[str] = ()) -> DataFrame:
    """(name_a, name_b, ``keep`` of both, blocking key, length_diff) for names of a block with name_a < name_b and lengths less than ``max_length_gap`` apart."""
    side = lambda s: df.select(F.col(key), F.col(name).alias(f"name_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in keep])
    gap = F.abs(F.length("name_a") - F.length("name_b"))
    joined = side("a").join(side("b"), key).filter((F.col("name_a") < F.col("name_b")) & (gap < max_length_gap))
    return joined.select("name_a", "name_b", *[f"{c}_{s}" for c in keep for s in "ab"], key, gap.alias("length_diff"))


def anti_by(new: DataFrame, old: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``new`` whose key ``old`` doesn't have yet. Null keys are never found, so they count as new; ``null_safe`` finds them.

    Always by a merge: a stored table of keys looks small by its file and takes a hundred times that as a broadcast in each task.
    """
    if not null_safe:
        return new.join(old.select(*keys).hint("merge"), list(keys), "left_anti")
    named = {k: private_name(new, f"__old_{i}") for i, k in enumerate(keys)}
    side = old.select(*[F.col(f"`{k}`").alias(n) for k, n in named.items()]).hint("merge")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in named.items()]
    return new.join(side, same, "left_anti")


def text_chunks(df: DataFrame, text: str, stride: int = 1500, width: int = 1700, least: int = 200, at_least: int = 5000) -> DataFrame:
    """Overlapping chunks of texts of ``at_least`` characters: chunk_start (from 1), chunk_end, chunk_length, chunk_text; those under ``least`` characters go."""
    total = F.length(text)
    have = df.filter(total >= max(at_least, 1))
    k = F.explode(F.sequence(F.lit(0), F.ceil(total / F.lit(float(stride))).cast("int") - 1))
    at = have.select("*", k.alias("__k")).withColumn("chunk_start", (F.col("__k") * stride + 1).cast("long")).drop("__k")
    cut = F.substring(F.col(text), F.col("chunk_start").cast("int"), F.lit(width))
    out = at.withColumn("chunk_end", F.least(F.col("chunk_start") + (width - 1), total.cast("long"))).withColumn("chunk_text", cut)
    return out.withColumn("chunk_length", F.length("chunk_text").cast("long")).filter(F.col("chunk_length") >= least)


def exact_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn at random, all rows if there are fewer."""
    return df.orderBy(F.rand(seed)).limit(n)


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row per ``row``, one column per known value; the values are given, so no job looks for them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(value))


def running_share(df: DataFrame, by: str, tie: str, share: str = "running_share", chunks: int = 0) -> DataFrame:
    """Rank and running share of the total, the largest first.

    A running sum over the whole table would sit in one task; so rows are
    range-partitioned, each partition sums its own, and the partitions' totals
    are added up in a table of as many rows as there are partitions.
    """
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, F.col(by).desc_nulls_last(), F.col(tie)).withColumn("__p", F.spark_partition_id())
    ordered = materialize(ordered, "running-share")
    totals = ordered.groupBy("__p").agg(F.sum(by).alias("__s"), F.count("*").alias("__c"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__rows"))
    whole = totals.agg(F.sum("__s").alias("__total"))
    own = W.partitionBy("__p").orderBy(F.col(by).desc_nulls_last(), F.col(tie))
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    out = ordered.withColumn("__r", F.row_number().over(own)).withColumn("__u", F.coalesce(F.sum(by).over(upto), F.lit(0)))
    out = out.join(F.broadcast(base), "__p").crossJoin(F.broadcast(whole))
    out = out.withColumn("rank", (F.col("__rows") + F.col("__r")).cast("long")).withColumn(share, (F.col("__before") + F.col("__u")) / F.nullif(F.col("__total"), F.lit(0)))
    return out.drop("__p", "__r", "__u", "__before", "__rows", "__total")
