import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portolan.operators import relational as rel
from portolan.operators.components import connected_components, spanning_forest
from portolan.operators.similarity import cosine_sums, cosine_top_k


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 560)] + [(700, 700)]
    edges += edges[:10]
    r.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 5), (6, None)], "src long, dst long").repartition(3)
    got = {x["node"]: x["component"] for x in connected_components(df, local_edges=local).collect()}
    assert got == brute_components(edges)


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_of_names_and_none(spark, local):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string")
    got = {x["node"]: x["component"] for x in connected_components(df, "a", "b", local).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(df.limit(0), "a", "b", local).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=25))
def test_spanning_forest(edges):
    import pandas as pd

    f = spanning_forest(pd.DataFrame(edges, columns=["a", "b"]))
    want = brute_components(edges)
    assert dict(zip(f["a"], f["b"])) == {k: v for k, v in want.items() if k != v}


def test_edges_are_contracted_once_and_again(monkeypatch):
    """Work grows with the edges, not with the batches they come in."""
    import pandas as pd

    from portolan.operators import components as C

    monkeypatch.setattr(C, "FOREST_STEP", 100)
    seen = []
    monkeypatch.setattr(C, "spanning_forest", lambda pdf: seen.append(len(pdf)) or spanning_forest(pdf))
    r = np.random.default_rng(1)
    edges = pd.DataFrame(r.integers(0, 3000, (20_000, 2)), columns=["a", "b"]).query("a != b")
    out = list(C._contract(edges.iloc[k : k + 50] for k in range(0, len(edges), 50)))
    assert len(out) == 1 and sum(seen) < 3 * len(edges) + 1000
    assert dict(zip(out[0]["a"], out[0]["b"])) == {k: v for k, v in brute_components(edges.itertuples(index=False, name=None)).items() if k != v}


def test_latest(spark):
    df = spark.createDataFrame([(1, "2020", "a"), (1, "2021", "b"), (2, None, "c"), (2, "2021", "d"), (3, "2020", "y"), (3, "2020", "x"), (None, "1", "p"), (None, "2", "q")], "k int, t string, v string")
    assert sorted(r["v"] for r in rel.latest_by(df, ["k"], "t").collect()) == ["b", "c", "q", "x"]
    assert sorted(r["v"] for r in rel.latest_by(df, ["k"], "t", nulls_first=False).collect()) == ["b", "d", "q", "x"]


def test_mode_and_shortest(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", None), ("b", "z"), ("c", None), ("c", None), ("c", "z")], "k string, v string")
    assert {r["k"]: (r["v"], r["n"]) for r in rel.mode_by(df, ["k"], ["v"]).collect()} == {"a": ("y", 2), "b": ("z", 1), "c": (None, 2)}
    df = spark.createDataFrame([("h", "long text", "1"), ("h", "b", "3"), ("h", "a", "2"), ("h", " ", "0"), (None, "x", "0"), ("g", None, "1")], "k string, d string, t string")
    assert [tuple(r) for r in rel.shortest_by(df, "k", "d", "t").collect()] == [("h", "a")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 4)), min_size=1, max_size=30))
def test_hhi_bounds(spark, rows):
    df = spark.createDataFrame(rows, "g string, h int")
    for r in rel.hhi(df, ["g"], ["h"]).collect():
        own = [h for g, h in rows if g == r["g"]]
        want = sum((own.count(h) / len(own)) ** 2 for h in set(own))
        assert 0 < r["hhi"] <= 1 + 1e-12 and r["hhi"] == pytest.approx(want) and r["top_share"] == pytest.approx(max(own.count(h) for h in own) / len(own))


def test_distinct_window_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 1), ("b", None)], "k string, v int")
    assert sorted((str(r["k"]), r["n"]) for r in rel.count_distinct_over(df, ["k"], "v", "n").collect()) == [("None", 1), ("None", 1), ("a", 2), ("a", 2), ("b", 0)]


def test_disjunctive_pairs(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 2, 3, None]), r.choice(["x", "y", "z", None])) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a int, b string")
    out = rel.disjunctive_pairs(df, "id", "a", "b")
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and ((p[1] is not None and p[1] == q[1]) or (p[2] is not None and p[2] == q[2]))}
    got = [(x["id_a"], x["id_b"]) for x in out.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocking_and_anti(spark):
    df = spark.createDataFrame([("k", "aa", "DE"), ("k", "ab", None), ("k", "a" * 30, "FR"), ("l", "aa", "DE"), (None, "x", "x"), (None, "y", "y")], "key string, n string, c string")
    assert sorted(tuple(r) for r in rel.blocking_pairs(df, "key", "n", keep=("c",)).collect()) == [("aa", "ab", "DE", None, "k", 0)]
    new, old = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(str(r["k"]) for r in rel.anti_by(new, old, ["k"]).collect()) == ["2", "None"]


def test_chunks(spark):
    texts = [(5000, "a"), (6100, "b"), (4999, "c"), (6000, "d"), (None, "e")]
    df = spark.createDataFrame([(k, None if n is None else "".join(chr(97 + i % 26) for i in range(n))) for n, k in texts], "k string, t string")
    got = {}
    for r in rel.text_chunks(df, "t").orderBy("k", "chunk_start").collect():
        got.setdefault(r["k"], []).append(r)
    assert [(r["chunk_start"], r["chunk_end"]) for r in got["a"]] == [(1, 1700), (1501, 3200), (3001, 4700), (4501, 5000)]
    assert [r["chunk_start"] for r in got["b"]] == [1, 1501, 3001, 4501] and [r["chunk_start"] for r in got["d"]] == [1, 1501, 3001, 4501] and set(got) == {"a", "b", "d"}
    whole = got["a"][0]["t"]
    assert got["a"][0]["chunk_text"] + "".join(r["chunk_text"][200:] for r in got["a"][1:]) == whole
    assert "".join(r["chunk_text"][:1500] for r in got["a"]) == whole


def test_sample_pivot_running_share(spark):
    df = spark.range(100)
    assert rel.exact_sample(df, 7, 1).count() == 7 and rel.exact_sample(df, 700, 1).count() == 100
    cells = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "r string, c string, v int")
    assert sorted(map(tuple, rel.pivot_matrix(cells, "r", "c", "v", ["x", "y", "z"]).collect())) == [("a", 1, None, None), ("b", None, 2, None)]
    rows = [(f"k{i}", i % 9 + 1) for i in range(60)]
    out = rel.running_share(spark.createDataFrame(rows, "k string, n int"), "n", "k", chunks=5).orderBy("rank").collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    total, run = sum(n for _, n in rows), 0
    for r, (k, n) in zip(out, order):
        run += n
        assert r["k"] == k and r["running_share"] == pytest.approx(run / total)
    assert rel.running_share(spark.createDataFrame([], "k string, n int"), "n", "k").count() == 0


@pytest.mark.parametrize("limit", [1 << 28, 2000])
def test_top_k(spark, limit):
    r = np.random.default_rng(0)
    q, x = r.normal(size=(40, 8)), r.normal(size=(90, 8))
    x[5] = x[3]
    x[40:75] = x[40]  # more equal ones than are looked at at first
    q[1] = x[40]
    q[0] = x[3]
    queries = spark.createDataFrame([(i, v.tolist(), None if i else 2**60 + 1) for i, v in enumerate(q)] + [(99, None, 1)], "q long, a array<double>, big long")
    refs = spark.createDataFrame([(f"{i:03d}", v.tolist(), f"d{i}") for i, v in enumerate(x)] + [("zzz", None, "none")], "code string, v array<double>, d string")
    got = {}
    for row in cosine_top_k(queries, refs, "a", "v", "code", 5, carry=("d",), limit=limit).collect():
        got.setdefault(row["q"], []).append((row["rank"], row["code"], row["sim"], row["d"]))
        assert row["big"] == (None if row["q"] else 2**60 + 1)
    un = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = un(q) @ un(x).T
    for i in range(40):
        order = sorted(range(90), key=lambda j: (-round(s[i, j], 9), j))[:5]
        have = sorted(got[i])
        assert [c for _, c, _, _ in have] == [f"{j:03d}" for j in order] and [k for k, *_ in have] == [1, 2, 3, 4, 5]
        assert [d for *_, d in have] == [f"d{j}" for j in order] and have[0][2] == pytest.approx(s[i, order[0]], abs=1e-9)
    assert len(got) == 40
    assert cosine_top_k(queries, refs.limit(0), "a", "v", "code", 5).count() == 0
    mine = cosine_top_k(refs.select(F.col("code").alias("me"), "v"), refs.select("code", F.col("v").alias("w")), "v", "w", "code", 3, exclude_equal="me", limit=limit)
    assert not mine.filter("me = code").count() and mine.count() == 270


def test_cosine_sums(spark):
    """As over all pairs, which aren't formed: ids with several vectors, missing keys, vectors without length or direction."""
    from portolan.functions.vector import cosine

    r = random.Random(3)
    rows = [(r.randint(0, 30), r.choice([1, 2, None]), [r.gauss(0, 1) for _ in range(r.choice([4, 4, 4, 3]))]) for _ in range(120)]
    rows += [(40, 1, [0.0] * 4), (41, 1, None), (42, 1, [1.0, None, 2.0, 3.0]), (None, 1, [1.0] * 4), (43, 5, [1.0, 2.0]), (44, 6, [0.0, 0.0]), (45, 6, [1.0, 0.0]), (45, 6, [0.5, 0.5]), (46, 7, [float("nan"), 1.0]), (47, 7, [1.0, 1.0]), (48, 7, [0.0, 0.0]), (49, 7, None), (50, 8, [float("inf"), 1.0]), (51, 8, [1.0, 1.0]), (51, 8, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>").repartition(3)
    a, b = df.select("id", "g", F.col("v").alias("a")), df.select(F.col("id").alias("other"), "g", F.col("v").alias("b"))
    want = a.join(b, "g").filter("id != other").groupBy("id").agg(F.sum(cosine(F.col("a"), F.col("b"))).alias("sim_sum"), F.count("*").alias("n"))
    said = lambda d: sorted((x["id"], "-" if x["sim_sum"] is None else f"{x['sim_sum'] + 0.0:.6f}".replace("-0.000000", "0.000000"), x["n"]) for x in d.collect())
    got = cosine_sums(df, "id", "g", "v")
    assert said(got) == said(want)
    # 30,000 rows of one group: 900 million pairs
    many = spark.range(30_000).select("id", F.lit(1).alias("g"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("v"))
    assert cosine_sums(many, "id", "g", "v").agg(F.sum("n"), F.count("*")).first()[:] == (30_000 * 29_999, 30_000)


def test_top_k_holds_blocks_of_similarities():
    """As from one product with all references, which took three times its size on top."""
    import tracemalloc

    from portolan.operators.similarity import _best, _best_in_blocks

    r = np.random.default_rng(1)
    x, q = r.integers(-3, 4, (60_000, 8)).astype(float), r.integers(-3, 4, (700, 8)).astype(float)  # many ties
    x, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) for v in (x, q))
    tracemalloc.start()
    at, sims = _best_in_blocks(q, x, 5)
    assert tracemalloc.get_traced_memory()[1] < 150e6  # one product: 168 MB, its order 336 MB
    tracemalloc.stop()
    want = _best(q, x, x.astype(np.float32), np.arange(len(x)), 5)
    assert (at == want[0]).all() and np.allclose(sims, want[1])
    at, sims = _best_in_blocks(q[:2], x[:3], 5)
    assert at.shape == (2, 3)
