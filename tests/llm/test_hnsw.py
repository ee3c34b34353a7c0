import numpy as np
from pyspark.sql import functions as F

from portolan.llm import hnsw as H


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_graph_recall():
    x = unit(np.random.default_rng(0).normal(size=(3000, 32)))
    g = H.Graph(x, H.HnswParams()).build()
    ids, _ = g.search(x[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(ids[i, :10]) & set(true[i])) / 10 for i in range(200)]) > 0.9
    assert all((lay < len(x)).all() for lay in g.layers)


def clustered(seed, groups, dim=32, noise=0.03):
    r = np.random.default_rng(seed)
    out = []
    for n in groups:
        c = r.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [c + noise * r.normal(size=dim) / np.sqrt(dim) * 3 for _ in range(n)]
    return unit(np.array(out))


def test_beams_widen_over_large_groups():
    x = clustered(1, [400, 5, 1, 1, 30])
    g = H.Graph(x, H.HnswParams(beam=8)).build()
    a, b, beam = g.audited(x, 3)
    true = x @ x.T >= 0.95
    assert true[a, b].sum() / true.sum() >= 0.97


def test_audit_counts_each_query_and_not_itself(monkeypatch):
    x = clustered(4, [60] + [2] * 100 + [1] * 740)
    g = H.Graph(x, H.HnswParams(beam=8)).build()
    whole = x @ x.T >= 0.95

    def blind(q, beam):
        """Finds small groups' pairs with wide beams only."""
        seen = whole if beam >= 64 else whole & (np.eye(len(x), dtype=bool) | (np.arange(len(x)) < 60))
        return np.nonzero(seen)

    monkeypatch.setattr(g, "matches", blind)
    for seed in range(5):
        a, b, beam = g.audited(x, seed, np.arange(len(x)))
        assert beam >= 64 and len(a) == whole.sum()


def brute(ids, x, threshold):
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(x.astype(np.float64) @ x.T >= threshold, 1))):
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return {ids[i]: ids[find(i)] for i in range(len(x))}


def test_groups_same_as_brute_force_over_shards(spark):
    x = clustered(2, [1] * 300 + [2] * 40 + [60, 25])
    order = np.random.default_rng(3).permutation(len(x))
    rows = [(int(i), x[k].tolist(), 7) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = H.near_duplicate_vectors(df, H.HnswParams(shard_rows=100)).collect()
    want = brute(list(range(len(x))), x[order], 0.95)
    got = {r["vec_id"]: r["group_id"] for r in out}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want) and len(got) == len(want)
    assert all(want[k] <= v for k, v in got.items()) and all(r["kept"] == (r["vec_id"] == r["group_id"]) for r in out)


def test_vectors_of_each_length_are_searched(spark):
    x, y = clustered(5, [3, 2, 1, 1], 16), clustered(6, [4, 1], 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, v.tolist()) for i, v in enumerate(y)] + [(200, y[0].tolist())]
    got = {r["vec_id"]: r["group_id"] for r in H.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), H.HnswParams(shard_rows=3)).collect()}
    assert got == brute(list(range(7)), x, 0.95) | {k: v for k, v in brute(list(range(100, 105)), y, 0.95).items()} | {200: 100}


def test_odd_vectors(spark):
    v = [1.0, 2.0, 2.0]
    rows = [(1, v), (2, [2.0, 4.0, 4.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, []), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [1.0, 2.0]), (None, v), (1, v), (9, [-1.0, -2.0, -2.0]), (10, [float("inf"), 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("h", F.lit("mine")).withColumn("group_id", F.lit(99)).withColumn("g", F.lit(5)).withColumn("__h", F.lit(6)).withColumn("__g", F.lit(7))
    out = H.near_duplicate_vectors(df)
    got = sorted((str(r["vec_id"]), str(r["group_id"]), r["kept"]) for r in out.collect())
    assert got == sorted([("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "1", False)] + [(str(k), str(k), True) for k in range(3, 11)])
    assert {(r["h"], r["g"], r["__h"], r["__g"]) for r in out.collect()} == {("mine", 5, 6, 7)}
    assert H.near_duplicate_vectors(df.limit(0)).count() == 0
    assert H.near_duplicate_vectors(df.filter("vec_id = 4")).count() == 1


def test_nearest_pivots():
    r = np.random.default_rng(7)
    for n in (1, 3, 70, 1000):
        q, x = unit(r.normal(size=(40, 16))), unit(r.normal(size=(n, 16)))
        got = H.nearest_pivots(q, x, 4)
        assert (np.sort(got, 1) == np.sort(np.argsort(-(q @ x.T), axis=1)[:, :4], 1)).all()


def test_links_of_a_cell():
    """Whole and by graphs: sure links hold, and with the doubtful ones that hold, too, give the groups of brute force."""
    x = clustered(8, [150, 40] + [2] * 60 + [1] * 100)
    x = x.astype(np.float16).astype(np.float32)
    true = x.astype(np.float64) @ x.T.astype(np.float64) >= 0.95
    for whole, least in ((1000, 1.0), (60, 0.98)):
        a, b, sure = H.cell_links(x, H.HnswParams(whole_rows=whole, shard_rows=100, block=64))
        assert len(a) < 2 * len(x)
        pairs = [(i, j) for i, j, s in zip(a, b, sure) if s or true[i, j]]
        parent = {i: i for i in range(len(x))}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            parent[max(find(i), find(j))] = min(find(i), find(j))
        want = brute(list(range(len(x))), x, 0.95)
        assert np.mean([find(i) == want[i] for i in range(len(x))]) >= least


def test_cells_keep_the_groups_and_the_work_in_proportion(spark, monkeypatch):
    """Twice the vectors are not compared with twice as many others each, and too few cells for each vector are found out by the audit."""
    r = np.random.default_rng(9)
    seen = []
    real = H.measured_recall
    monkeypatch.setattr(H, "measured_recall", lambda *a: seen.append(real(*a)) or seen[-1])
    p = H.HnswParams(route_from=500, pivot_rows=25, cells=1, whole_rows=2000)
    mates = {}
    for n in (1000, 2000):
        x = unit(r.normal(size=(n // 2, 64)))
        u = r.normal(size=x.shape)
        u = unit(u - (u * x).sum(1, keepdims=True) * x)
        both = unit(np.concatenate([x, 0.96 * x + (1 - 0.96**2) ** 0.5 * u]))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<float>")
        seen.clear()
        got = {row["vec_id"]: row["group_id"] for row in H.near_duplicate_vectors(df, p).collect()}
        want = brute(list(range(n)), both, 0.95)
        assert np.mean([got[k] == want[k] for k in want]) >= 0.97 and seen[0] < 0.97 <= seen[-1] and len(seen) < 5
        at = H.nearest_pivots(both, both[:: 25], 4)
        mates[n] = (np.bincount(at.ravel()) ** 2).sum() / n
    assert mates[2000] < 1.5 * mates[1000]
