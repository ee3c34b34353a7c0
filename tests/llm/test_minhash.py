import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import keep_extra

from portolan.llm import minhash as M
from portolan.llm.shingles import shingle_keys, slices

P = M.MinHashParams()
WORDS = [a + b + c for a in "bcdfgklmn" for b in "aeiou" for c in "lmnrst"]


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(t, seed, share=0.06):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in t.split())


def brute_features(texts):
    sets = []
    for t in texts:
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        shingles = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])
        counts = {}
        for s in shingles:
            counts[s] = counts.get(s, 0) + 1
        sets.append(counts)
    return sets


def brute_groups(pairs, threshold):
    """Survivors by all pairs' weighted Jaccard similarity, in plain Python."""
    rows = sorted(set(pairs), key=lambda p: (p[0] is None, p[0] or 0))
    feats = brute_features([t for _, t in rows])
    have = [i for i, f in enumerate(feats) if f]
    distinct = {rows[i][1]: feats[i] for i in have}
    n = len([1 for t in pairs if brute_features([t[1]])[0]])
    df = {}
    for _, t in pairs:
        for s in brute_features([t])[0]:
            df[s] = df.get(s, 0) + 1
    idf = lambda s: np.log1p(1 / (df[s] / n + P.smoothing))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    del distinct
    for a, b in combinations(have, 2):
        fa, fb = feats[a], feats[b]
        low = sum(min(fa[s], fb[s]) * idf(s) for s in fa if s in fb)
        sim = low / (sum(c * idf(s) for s, c in fa.items()) + sum(c * idf(s) for s, c in fb.items()) - low)
        if sim >= threshold:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(str(rows[i][0]) for i in range(len(rows)) if find(i) == i)


def survivors(df, **kw):
    return sorted(str(r["doc_id"]) for r in M.drop_near_duplicates(df, **kw).select("doc_id").collect())


def agrees(df, pairs, **kw):
    """Nothing goes that brute force keeps, and at least nine in ten of what it takes out go."""
    mine, true = survivors(df, **kw), brute_groups(pairs, P.threshold)
    assert set(true) <= set(mine)
    gone = len(pairs) - len(true)
    assert len(pairs) - len(mine) >= 0.9 * gone > 0


def test_same_as_brute_force(docs):
    pairs = [(i, text(i)) for i in range(60)]
    for g in range(8):
        pairs += [(100 + 20 * g + i, edited(text(g), 1000 + 20 * g + i)) for i in range(1 + 2 * g)]
    pairs += [(900 + i, pairs[i][1]) for i in range(5)]
    agrees(docs(pairs).repartition(5), pairs, params=M.MinHashParams(crowd=0))  # the bound rules out nothing that is near


def test_large_group_of_copies_and_chain(docs):
    base = text(7)
    pairs = [(i, base) for i in range(60)] + [(1000 + i, edited(base, i, 0.04)) for i in range(40)] + [(5000 + i, text(300 + i, 40)) for i in range(200)]
    link = base
    for i in range(6):  # each is near the one before; the ends aren't near each other
        link = edited(link, 50 + i, 0.07)
        pairs.append((2000 + i, link))
    agrees(docs(pairs), pairs)


def test_shared_passage_is_no_duplicate(docs):
    passage = text(99, 55)
    pairs = [(i, text(i, 100) + " " + passage + " " + text(500 + i, 100)) for i in range(20)]
    assert len(survivors(docs(pairs))) == 20


def test_bound_on_unlike_texts_with_a_shared_header(spark):
    """5,000 texts with one header in one bucket: few pairs are left to settle, and all that are near are among them."""
    header = text(1, 60)
    rows = [header + " " + text(100 + i, 140) for i in range(5000)]
    for i in range(40):  # near pairs among them
        rows[-1 - i] = edited(rows[i], i, 0.05)
    texts = spark.createDataFrame(list(enumerate(rows)), "h long, t string").repartition(4)
    df, n = M.document_frequencies(texts.select("t"), P)
    idf = spark.sparkContext.broadcast(M.idf_table(df, n, P))
    placed = spark.createDataFrame([(9, i, 0, i, 0) for i in range(len(rows))], "bucket long, h long, first long, g long, fg long")
    found = {(r["a"], r["b"]) for r in M.late_pairs(placed, texts, idf, P).collect()}
    assert {(i, 4999 - i) for i in range(1, 40)} <= found  # 0 is the first, whose pairs are settled before
    assert len(found) < 50_000 < 5000 * 4999 / 2 / 200


def test_an_empty_id_is_no_missing_id(spark):
    for k in (None, "a"):
        df = spark.createDataFrame([("", text(3)), (None, text(3)), (k, text(4))], "doc_id string, text string")
        got = sorted((str(r["doc_id"]), r["text"]) for r in M.drop_near_duplicates(df).collect())
        assert got == sorted([("", text(3)), (str(k), text(4))])


def test_repeats_leave_other_rows_alone(spark):
    t = text(5)
    df = spark.createDataFrame([(1, t, "a"), (1, t, "b"), (1, t, "b"), (2, t, "c"), (3, text(6), "d"), (3, text(7), "e"), (4, None, "f"), (4, None, "g"), (4, None, "g")], "doc_id long, text string, v string")
    out = M.drop_near_duplicates(df.repartition(3))
    got = sorted((r["doc_id"], r["v"]) for r in out.collect())
    assert [k for k, _ in got] == [1, 3, 3, 4] and got[1:3] == [(3, "d"), (3, "e")] and got == sorted((r["doc_id"], r["v"]) for r in out.collect())


def test_nulls_blanks_ties_and_repeats(docs):
    t = text(3)
    pairs = [(1, None), (2, None), (3, ""), (4, "  \n"), (5, "!!! ---"), (None, t), (7, t), (6, t), (6, t), (8, "one"), (9, "One!"), (10, "two words"), (10, "other text here")]
    df = docs(pairs)
    out = M.drop_near_duplicates(df)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert got == sorted([("1", "None"), ("2", "None"), ("3", ""), ("4", "  \n"), ("5", "!!! ---"), ("6", t), ("8", "one"), ("10", "two words"), ("10", "other text here")])
    assert out.columns == df.columns
    keep_extra(out, df)


def test_empty_and_long(docs):
    assert survivors(docs([])) == []
    long = text(1, 120_000)
    assert survivors(docs([(1, long), (2, edited(long, 5, 0.03)), (3, text(2, 100))])) == ["1", "3"]


def test_shingles_are_exact_and_don_t_cross_rows():
    texts = ["A b c d", None, "a B c", "x", "", "x y", "é è ü w"]
    seen = {}
    for first, data, off in slices(pa.array(texts)):
        row, key, count = shingle_keys(data, off, 3)
        for r, k, c in zip(row, key, count):
            seen.setdefault(first + int(r), []).append((int(k), int(c)))
    assert {k: len(v) for k, v in seen.items()} == {0: 2, 2: 1, 3: 1, 5: 1, 6: 2}
    assert seen[2][0] in seen[0]
    repeated = list(slices(pa.array(["p q r p q r p q r"])))[0]
    assert sorted(shingle_keys(repeated[1], repeated[2], 3)[2].tolist()) == [2, 2, 3]


@pytest.mark.parametrize("share", [0.05, 0.12, 0.25])
def test_samples_agree_as_often_as_weights_do(share):
    p = M.MinHashParams(bands=400, rows=1)
    a, b = text(1, 400), edited(text(1, 400), 9, share)
    idf = np.full(1 << p.idf_bits, 1.5, np.float32)
    (_, ka, wa), (_, kb, wb) = M.features(pa.array([a, b]), idf, p)
    wa = wa * (1 + np.arange(len(wa)) % 3)
    agree = (M.signature(ka, wa, p) == M.signature(kb, wb, p)).mean()
    assert abs(agree - M.weighted_jaccard(ka, wa, kb, wb)) < 0.1
