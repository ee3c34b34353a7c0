import corpus_pipeline
from pyspark.sql import functions as F

from portolan.llm import pii, queries, tokens
from test_minhash import brute_groups
from test_pii import naive

BPE = tokens.tokenizer("tiktoken", open(tokens.BYTES, "rb").read())


def brute_mask(text, w):
    """The text masked by the best path, found state by state from scores written out for each character."""
    score = naive(text, w, pii.PiiParams().lean)
    best, back = score[0] + w["first"], []
    for row in score[1:]:
        ways = [[best[i] + w["trans"][i, j] for i in range(len(best))] for j in range(len(best))]
        back.append([max(range(len(best)), key=x.__getitem__) for x in ways])
        best = [max(x) + row[j] for j, x in enumerate(ways)]
    at = max(range(len(best)), key=lambda j: best[j] + w["last"][j])
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    path = path[::-1]
    edges = [0, *[i for i in range(1, len(path)) if path[i] != path[i - 1]], len(path)]
    return pii.masked(text, pii.reconcile(text, [(a, b, path[a]) for a, b in zip(edges, edges[1:]) if path[a]]))


def test_stages_in_order_and_same_as_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0  # nothing is made up
        if name == "near-duplicates":
            true = set(brute_groups([(r["doc_id"], r["text"]) for r in before.collect()], 0.5))
            mine = {str(r["doc_id"]) for r in docs.collect()}
            assert true <= mine and sizes[-2] - len(mine) >= 0.9 * (sizes[-2] - len(true))
        if name == "personal data":
            assert not docs.filter(F.col("text").rlike(r"@mail\d|\) 555-\d{4}|[0-9]{16}|[0-9a-f]{40}")).count()
            mine = {r["doc_id"]: r["text"] for r in docs.collect()}
            short = [r for r in before.filter("length(text) <= 1000").orderBy("doc_id").collect()][:60]
            weights = pii.train(pii.PiiParams())
            assert len(short) > 20 and {r["doc_id"]: mine[r["doc_id"]] for r in short} == {r["doc_id"]: brute_mask(r["text"], weights) for r in short}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "source mixing", "packing"]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4]
    kept = {r["doc_id"] for r in before.select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        at = 0
        for k, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            pieces.setdefault(k, []).append((s, r["token_ids"][at : at + n]))
            at += n
    assert pieces.keys() == kept
    for k, found in pieces.items():
        ids = [x for _, part in sorted(found) for x in part]
        assert ids[-1] == tokens.BYTES_END and BPE.decode(ids[:-1]) == texts[k]


ODD = [(1, None), (2, ""), (3, " \n "), (4, "A clean line of text. It goes on."), (4, "A clean line of text. It goes on."), (5, "A clean line of text. It goes on."), (None, "Another one for you to read. Fine."), (6, "Call +1 (017) 555-7713 today. " * 4000), (7, None)]


def test_every_stage_takes_odd_rows_and_none(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (ODD, [], [(1, None)]):
            df = docs(rows).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") != 4, F.col("source")))
            df = df.withColumn("n_chars", F.when(F.col("doc_id") != 5, F.col("n_chars")))
            out = stage(spark, df, sf)
            got = out.collect()
            if name != "packing":
                assert out.columns == df.columns
            if not rows:
                assert not got
            elif name in ("near-duplicates", "personal data"):
                assert {1} <= {r["doc_id"] for r in got}
            if name == "near-duplicates" and rows is ODD:
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "6", "7", "None"]
            if name == "quality rules" and rows is ODD:
                assert sorted(str(r["doc_id"]) for r in got) == ["4", "4", "5", "6", "None"]


def test_queries_and_sql_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) < set(names)
