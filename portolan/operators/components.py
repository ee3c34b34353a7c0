"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.session import discard, materialize, ship_code


FOREST_STEP = 50_000  # edges


def spanning_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) with b the least node of a's component, one per node that is not that least node."""
    codes, nodes = pd.factorize(pd.concat([pdf["a"], pdf["b"]], ignore_index=True), sort=True)
    half = len(pdf)
    parent = list(range(len(nodes)))
    for x, y in zip(codes[:half].tolist(), codes[half:].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.asarray(parent, dtype=np.int64)
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    child = np.flatnonzero(root != np.arange(len(root)))
    nodes = pd.Series(np.asarray(nodes), dtype=pdf["a"].dtype)
    return pd.DataFrame({"a": nodes.iloc[child].to_numpy(), "b": nodes.iloc[root[child]].to_numpy()})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of all batches. New edges wait until they are as many as the forest's, so each edge is looked at twice on average and not once for each batch."""
    held, waiting, n = None, [], 0
    for pdf in batches:
        if len(pdf):
            waiting.append(pdf)
            n += len(pdf)
            if n >= max(FOREST_STEP, 0 if held is None else len(held)):
                held = spanning_forest(pd.concat([*([] if held is None else [held]), *waiting], ignore_index=True))
                waiting, n = [], 0
    if waiting:
        held = spanning_forest(pd.concat([*([] if held is None else [held]), *waiting], ignore_index=True))
    if held is not None:
        yield held


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(least, "a").select("b", "m").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", local_edges: int = 500_000) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node of its component.

    Each partition first replaces its edges by a spanning forest, so that at
    most one edge per node and partition is shuffled. What is left is finished
    by one task if it is at most ``local_edges`` edges, else by alternating
    large-star and small-star steps (Kiveris et al., 2014), each round written
    to the shared folder, until no edge changes. Both ways are exact; which
    one runs does not show in the result.

    Edges with a null end are ignored; self-loops only name their node; the
    order and repetition of edges have no effect; no edges give no rows.
    """
    ship_code(edges.sparkSession)
    kind = edges.schema[src].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    loops = pairs.filter("a = b").select("a").distinct()
    current = materialize(pairs.filter("a != b").mapInPandas(_contract, schema), "cc-forest")
    if current.count() <= local_edges:
        star = current.coalesce(1).mapInPandas(_contract, schema)
        done = materialize(star, "cc-star")
        discard(current)
    else:
        seen = None
        while True:
            done = materialize(_small_star(_large_star(current)), "cc-round")
            discard(current)
            mark = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            current = done
            if mark == seen:
                break
            seen = mark
    members = done.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = done.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    lone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    named = members.unionAll(roots)
    return named.unionAll(lone.join(named.select("node"), "node", "left_anti"))
