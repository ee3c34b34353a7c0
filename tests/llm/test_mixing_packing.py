import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest_llm import keep_extra
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portolan.llm import mixing, packing, tokens

TEXT = "one two three four five six"


def make(spark, docs, n=600):
    df = docs([(i, TEXT) for i in range(n)])
    return df.withColumn("source", F.when(F.col("doc_id") % 10 < 7, "hot").when(F.col("doc_id") % 10 == 7, "mid").otherwise("rare")).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("en"))


def test_weights_meet_the_marginals(spark, docs):
    p = mixing.MixParams(targets={"source": {"hot": 0.5, "mid": 0.25, "rare": 0.25}, "lang": {"en": 0.5, "fr": 0.5}}, fraction=0.5)
    cells = pd.DataFrame({"source": ["hot", "hot", "mid", "mid", "rare", "rare"], "lang": ["en", "fr"] * 3, "topic": ["general"] * 6, "tokens": [700, 100, 50, 60, 10, 80]})
    w = mixing.rake(cells, mixing.target_shares(cells, p), 100)
    by = lambda c: (cells.assign(w=w).groupby(c)["w"].sum() / w.sum()).to_dict()
    assert by("source") == pytest.approx({"hot": 0.5, "mid": 0.25, "rare": 0.25}) and by("lang") == pytest.approx({"en": 0.5, "fr": 0.5})


def test_driver_and_distributed_raking_agree(spark, docs):
    df = make(spark, docs)
    a = mixing.mix_sources(df, mixing.MixParams(bounded=False, rounds=12), weights=True)
    b = mixing.mix_sources(df, mixing.MixParams(bounded=False, rounds=12, driver_cells=0, broadcast_cells=0), weights=True)
    cols = ["doc_id", F.round("keep_probability", 9).alias("p"), F.round("mix_weight", 9).alias("m")]
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    keep_extra(a, df)


def test_sample_follows_the_probabilities(spark, docs):
    out = mixing.mix_sources(make(spark, docs, 6000), mixing.MixParams(bounded=False), weights=True).groupBy("source").agg(F.count("*").alias("n"), F.avg("keep_probability").alias("p")).collect()
    whole = {"hot": 4200, "mid": 600, "rare": 1200}
    for r in out:
        assert r["n"] / whole[r["source"]] == pytest.approx(r["p"], abs=0.05)
    assert {r["source"]: r["p"] for r in out}["hot"] < 0.85


def test_mixing_odd_rows(docs):
    df = docs([(1, None), (2, ""), (3, "  "), (4, TEXT), (4, TEXT), (None, TEXT), (None, None)])
    df = df.withColumn("source", F.when(F.col("doc_id") == 2, None).otherwise(F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    out = mixing.mix_sources(df, mixing.MixParams(fraction=1.0))
    assert out.count() == 7 and out.columns == df.columns  # one cell of each source: all is kept
    assert mixing.mix_sources(docs([])).count() == 0
    again = mixing.mix_sources(make(None, docs, 500)).select("doc_id").collect()
    assert again == mixing.mix_sources(make(None, docs, 500)).select("doc_id").collect()
    with pytest.raises(ValueError):
        mixing.mix_sources(df, mixing.MixParams(targets={"source": {"nowhere": 1.0}}))


def test_mixing_same_as_sql(spark, sf):
    mine = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"), weights=True).toPandas().sort_values("doc_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    theirs = db.execute(mixing.mix_sources_sql()).df().sort_values("doc_id").reset_index(drop=True)
    assert mine["doc_id"].tolist() == theirs["doc_id"].tolist() and mine["topic"].tolist() == theirs["topic"].tolist()
    np.testing.assert_allclose(mine["keep_probability"], theirs["keep_probability"], atol=1e-6)
    assert mine["mix_weight"].round(6).eq(1).all()


def test_documents_of_the_sample_meet_the_targets(spark):
    """The shares of the tokens that are kept, counted without any weight, in the tables that the query reads."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("topic", mixing.topic(F.lower("text"))).withColumn("tokens", mixing.tokens(F.col("text")))
    count = lambda x: x.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()
    whole, kept = count(df), count(mixing.mix_sources(df))
    for d, share in mixing.target_shares(whole, mixing.MixParams()).items():
        mine = kept.groupby(d)["tokens"].sum() / kept["tokens"].sum()
        assert (mine - share).abs().max() < 0.01
    assert kept["tokens"].sum() > 0.3 * whole["tokens"].sum()
    assert len(whole["topic"].unique()) == 5


def test_mixing_very_long_text(docs):
    df = docs([(i, TEXT) for i in range(50)] + [(99, "word " * 400_000 + "http://x")])
    out = mixing.mix_sources(df, mixing.MixParams(fraction=1.0, targets={"topic": {"general": 0.5, "technical": 0.5}}), weights=True)
    p = {r["topic"]: r["keep_probability"] for r in out.select("topic", "keep_probability").collect()}
    assert p["general"] == pytest.approx(1.0) and p.get("technical", 0) < 0.01  # the long text counts whole, so it can hardly stay


def topics(spark, n=20_000):
    text = F.when(F.col("id") % 40 == 0, "one two three <email> five six").otherwise(F.lit(TEXT))
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 7 < 2, "es").otherwise("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"))


@pytest.mark.parametrize("limits", [{}, {"driver_cells": 0, "broadcast_cells": 0, "rounds": 25}])
def test_bounded_sample_itself_meets_the_targets(spark, limits):
    df = topics(spark)
    whole = df.groupBy("source", "lang", mixing.topic(F.lower("text")).alias("topic")).agg((F.count("*") * 6).alias("tokens")).toPandas()
    p = mixing.MixParams(bounded=True, **limits)
    shares = mixing.target_shares(whole, p)
    out = mixing.mix_sources(df, p, weights=True).toPandas()
    assert out["mix_weight"].tolist() == pytest.approx([1.0] * len(out)) and out["keep_probability"].max() <= 1
    cells = whole.merge(out.groupby(["source", "lang", "topic"])["keep_probability"].first().reset_index())
    assert len(cells) == len(whole)
    w = (cells["tokens"] * cells["keep_probability"]).to_numpy()
    assert mixing.marginal_gap(cells, w, shares) < 1e-4
    room = min((whole.groupby(d)["tokens"].sum() / whole["tokens"].sum() / shares[d]).min() for d in shares)
    assert w.sum() / whole["tokens"].sum() > 0.95 * min(p.fraction, room)  # no more is dropped than the targets need
    for d in shares:
        assert (out[d].value_counts(normalize=True) - shares[d]).abs().max() < 0.02


def test_bounded_raking_tells_what_it_can_not_meet():
    cells = pd.DataFrame({"source": ["a", "b"], "lang": ["en", "fr"], "topic": ["general"] * 2, "tokens": [50, 50]})
    p = mixing.MixParams(targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.2, "fr": 0.8}}, bounded=True)
    with pytest.warns(UserWarning, match="off by"):
        mixing.rake_bounded(cells, mixing.target_shares(cells, p), p)


def test_pipeline_sample_meets_the_targets(spark):
    import corpus_pipeline

    df = topics(spark)
    p = mixing.MixParams()
    whole = df.withColumn("topic", mixing.topic(F.lower("text"))).groupBy("source", "lang", "topic").agg((F.count("*") * 6).alias("tokens")).toPandas()
    kept = corpus_pipeline.mix_sources(spark, df, "").withColumn("topic", mixing.topic(F.lower("text"))).toPandas()
    for d, share in mixing.target_shares(whole, p).items():
        assert (kept[d].value_counts(normalize=True) - share).abs().max() < 0.02


# Packing


def brute(lengths, window, limit):
    """Best fit over all open windows, by looking at each."""
    open_, closed = [], []
    for i, n in enumerate(lengths):
        fits = [w for w in open_ if w[0] >= n]
        if fits:
            w = min(fits, key=lambda w: (w[0], w[1]))
        else:
            if len(open_) >= limit:
                fullest = min(open_, key=lambda w: (w[0], w[1]))
                open_.remove(fullest)
                closed.append(fullest[2])
            w = [window, max([w[1] for w in open_] + [brute.n]) + 1, []]
            brute.n = w[1]
            open_.append(w)
        w[0] -= n
        w[2].append(i)
        if not w[0]:
            open_.remove(w)
            closed.append(w[2])
    return sorted(closed), sorted(w[2] for w in open_)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_packer_same_as_brute_force(lengths, limit):
    packer = packing.Packer(20, limit)
    closed = [s for i, n in enumerate(lengths) for _, s in packer.place(n, [i])]
    brute.n = -1
    want = brute(lengths, 20, limit)
    assert (sorted(closed), sorted(s for _, s in packer.rest())) == want
    assert len(packer.room) <= limit


BPE = tokens.tokenizer("tiktoken", open(tokens.BYTES, "rb").read())


def ids_of(text):
    return [*BPE.encode(text), tokens.BYTES_END]


def check(df, p):
    rows = packing.pack(df, p).collect()
    parts = {}
    for r in rows:
        assert 0 < r["n_tokens"] <= p.window and sum(r["lengths"]) == r["n_tokens"] == len(r["token_ids"])
        at = 0
        for k, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            parts.setdefault(k, []).append((s, r["token_ids"][at : at + n]))
            at += n
    assert len({r["window_id"] for r in rows}) == len(rows)
    return rows, {k: sorted(v) for k, v in parts.items()}


def whole(pieces):
    return [x for _, ids in pieces for x in ids]


def test_every_token_is_in_one_window(docs):
    pairs = [(i, " ".join(f"w{i}_{j}" for j in range(1 + i * 7 % 50))) for i in range(400)] + [(999, "\n".join(map(str, range(1000)))), (1000, "漢字" * 3000)]
    rows, parts = check(docs(pairs).repartition(7), packing.PackParams(window=64, open_windows=4, fan_in=2))
    assert {k: whole(v) for k, v in parts.items()} == {k: ids_of(t) for k, t in pairs}
    assert len(rows) <= 1.1 * sum(len(ids_of(t)) for _, t in pairs) / 64 + 2


def test_merge_same_as_brute_force():
    """Leftovers, fullest first, each into the window it fits best, however many are open."""
    r = np.random.default_rng(8)
    for n, window, last in ((1, 20, True), (40, 20, True), (60, 30, False), (200, 64, False)):
        sizes = r.integers(1, window, n)
        ids = [np.arange(k * 100, k * 100 + m, dtype=np.int32) for k, m in enumerate(sizes)]
        pdf = pd.DataFrame({"window_id": np.arange(n), "n_tokens": sizes, "doc_ids": [[str(k)] for k in range(n)], "starts": [[0]] * n, "lengths": [[int(m)] for m in sizes], "token_ids": ids, "part": 3, "open": True})
        p = packing.PackParams(window=window, open_windows=8)
        out = packing._merger(p, 1, last)((3,), pdf)
        order = sorted(range(n), key=lambda k: (-sizes[k], k))
        brute.n = -1
        closed, open_ = brute([int(sizes[k]) for k in order], window, n)
        want = sorted([str(order[i]) for i in w] for w in closed + open_)
        assert sorted(out["doc_ids"].tolist()) == want
        for r_ in out.itertuples():
            assert r_.token_ids.tolist() == [x for k in r_.doc_ids for x in ids[int(k)]] and r_.n_tokens == len(r_.token_ids)
        rest = sorted(sum(sizes[order[i]] for i in w) for w in open_)
        assert sorted(out[out["open"]]["n_tokens"]) == ([] if last else rest[: p.open_windows])  # the emptiest wait for the next level


def test_packing_odd_rows(docs):
    pairs = [(1, None), (2, ""), (3, "   "), (4, "a b"), (4, "a b"), (None, "c"), (5, "x" * 100_000), (6, "w " * 50_000 + "w"), (7, "a" + " " * 1_000_000 + "b")]
    rows, parts = check(docs(pairs), packing.PackParams(window=16))
    assert sorted(map(str, parts)) == ["4", "5", "6", "7", "None"] and parts[4] == [(0, ids_of("a b"))] * 2
    assert all(whole(parts[k]) == ids_of(t) for k, t in pairs[6:])
    big = [(2**60 + 1, "a"), (None, "b"), (2**60 + 3, "c d")]
    assert sorted(map(str, check(docs(big), packing.PackParams(window=16))[1])) == sorted(["None", str(2**60 + 1), str(2**60 + 3)])
    assert packing.pack(docs([])).count() == 0
    assert packing.pack(docs([(1, None)])).count() == 0
