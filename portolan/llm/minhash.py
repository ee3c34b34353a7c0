"""Near-duplicate documents by weighted MinHash.

Improved consistent weighted sampling (Ioffe, 2010) over TF-IDF weights of
word shingles, banded into buckets; every pair a bucket holds is settled by
the weighted Jaccard similarity itself, and groups are the connected
components of the pairs that reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.shingles import U, mix, shingle_keys, slices
from portolan.operators.components import connected_components
from portolan.session import arrow_batches, discard, materialize, private_name, ship_code


@dataclass(frozen=True)
class MinHashParams:
    """``bands`` bands of ``rows`` samples find a pair of similarity s with probability 1-(1-s^rows)^bands: 0.96 at 0.5, 0.996 at 0.6."""

    words: int = 3
    threshold: float = 0.5
    bands: int = 24
    rows: int = 3
    idf_bits: int = 20  # document frequencies are kept for 2^idf_bits hashed features: 4 MB of weights whatever the corpus
    smoothing: float = 0.05  # idf = ln(1 + 1/(df/N + smoothing)): what fewer than about 5 % of documents have counts as rare, so that the size of a group of copies hardly lowers their similarity
    table_bits: int = 12
    batch_rows: int = 1000  # documents or pairs that a Python worker holds at once
    crowd: int = 20_000  # pairs of a bucket from which on only those are settled that a bound can't rule out; has no effect on the groups
    seed: int = 7


_BLOCK = 1 << 12
_FREQ = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("df", T.BinaryType())])
_tables: dict = {}


def _variates(p: MinHashParams) -> tuple[np.ndarray, ...]:
    """r, 1/r, beta and ln c of the sampling, for every sample a row, for every hash a column."""
    if p not in _tables:
        rng = np.random.Generator(np.random.PCG64(p.seed))
        shape = (p.bands * p.rows, 1 << p.table_bits)
        r, c = rng.gamma(2.0, 1.0, shape), rng.gamma(2.0, 1.0, shape)
        _tables[p] = tuple(np.ascontiguousarray(x, np.float32) for x in (r, 1 / r, rng.random(shape), np.log(c)))
    return _tables[p]


def document_frequencies(texts: DataFrame, p: MinHashParams) -> tuple[np.ndarray, int]:
    """How many (document, distinct shingle) fall on each hashed feature, and the number of documents with a word; over every row."""
    bits, n = p.idf_bits, p.words
    block = min(_BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, held, waiting = np.zeros(1 << bits, np.int64), 0, [], 0
        for batch in batches:
            for _, data, off in slices(batch.column(0)):
                row, key, _ = shingle_keys(data, off, n)
                docs += len(np.unique(row))
                held.append((key & U((1 << bits) - 1)).astype(np.int64))
                waiting += len(key)
                if waiting > 1 << 21:
                    df += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, waiting = [], 0
        if held:
            df += np.bincount(np.concatenate(held), minlength=1 << bits)
        if docs:
            parts = df.astype(np.uint32).reshape(-1, block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([docs] + [0] * (len(parts) - 1), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "n_docs", "df"])

    def add(pdf):
        total = np.zeros(block, np.uint64)
        for x in pdf["df"]:
            total += np.frombuffer(x, np.uint64 if len(x) == 8 * block else np.uint32)
        return pdf.iloc[:1].assign(n_docs=pdf["n_docs"].sum(), df=total.tobytes())

    df, docs = np.zeros(1 << bits, np.uint64), 0
    for r in texts.mapInArrow(count, _FREQ).groupBy("block").applyInPandas(add, _FREQ).collect():  # 2^idf_bits counters, whatever the corpus
        df[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["df"], np.uint64)
        docs += r["n_docs"]
    return df, docs


def idf_table(df: np.ndarray, docs: int, p: MinHashParams) -> np.ndarray:
    return np.log1p(1.0 / (df / max(docs, 1) + p.smoothing)).astype(np.float32)


def features(texts: pa.Array, idf: np.ndarray, p: MinHashParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, keys ascending, weights) for each row that has a word."""
    mask = U(len(idf) - 1)
    for first, data, off in slices(texts):
        row, key, tf = shingle_keys(data, off, p.words)
        weight = tf * idf[(key & mask).astype(np.int64)]
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.r_[cut[1:], len(row)]):
            yield first + int(row[a]), key[a:b], weight[a:b]


def signature(key: np.ndarray, weight: np.ndarray, p: MinHashParams) -> np.ndarray:
    """One hash for each band. Two texts agree on one sample with the probability of their weighted Jaccard similarity."""
    r_tab, inv_tab, beta_tab, c_tab = _variates(p)
    mask = U((1 << p.table_bits) - 1)
    samples = p.bands * p.rows
    best = np.full(samples, np.inf, np.float32)
    best_key, best_t = np.zeros(samples, U), np.zeros(samples, np.int64)
    every = np.arange(samples)
    logs = np.log(weight).astype(np.float32)
    for a in range(0, len(key), 2048):
        k, s = key[a : a + 2048], logs[a : a + 2048]
        i, j, m = ((k >> U(x) & mask).astype(np.intp) for x in (48 - p.table_bits, 48 - 2 * p.table_bits, 48 - 3 * p.table_bits))
        beta = np.take(beta_tab, j, axis=1, mode="clip")
        t = np.take(inv_tab, i, axis=1, mode="clip")
        t *= s
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= 1
        beta *= np.take(r_tab, i, axis=1, mode="clip")
        beta += np.take(c_tab, m, axis=1, mode="clip")  # ln a = ln c - r (t - beta + 1)
        at = beta.argmin(axis=1)
        low = beta[every, at]
        better = low < best
        best[better] = low[better]
        best_key[better] = k[at[better]]
        best_t[better] = t[every, at][better].astype(np.int64)
    h = mix(best_key ^ mix(best_t.astype(U) + every.astype(U) * U(0x9E3779B97F4A7C15)))
    band = np.zeros(p.bands, U)
    for k in range(p.rows):
        band = mix(band + h[k :: p.rows])
    return mix(band + np.arange(p.bands, dtype=U)).view(np.int64)


def weighted_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    if len(ka) > len(kb):
        ka, wa, kb, wb = kb, wb, ka, wa
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    low = np.minimum(wa, wb[at])[kb[at] == ka].sum(dtype=np.float64)
    return float(low / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low))


def _signatures(rows: DataFrame, idf, p: MinHashParams) -> DataFrame:
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, p.bands), np.int64)
            has = np.zeros(batch.num_rows, bool)
            for row, key, weight in features(batch.column(2), idf.value, p):
                out[row], has[row] = signature(key, weight, p), True
            offsets = pa.array(np.r_[0, np.cumsum(has * p.bands)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(out[has].ravel()))], ["h", "k", "bands"])

    return rows.mapInArrow(sign, schema)


def _verified(pairs: DataFrame, texts: DataFrame, idf, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold, with their similarity."""
    schema = "a long, b long, similarity double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                a = batch.column(0).to_numpy()
                known = {row: (k, w) for row, k, w in features(batch.column(3), idf.value, p)}
                new = np.flatnonzero(np.r_[a[0] != last, a[1:] != a[:-1]])
                lefts = {int(new[i]): (k, w) for i, k, w in features(batch.column(2).take(pa.array(new)), idf.value, p)}
                sim = np.zeros(len(a))
                for i in range(len(a)):
                    left = lefts.get(i, left)
                    sim[i] = weighted_jaccard(*left, *known[i])
                last = a[-1]
                ok = sim >= p.threshold
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(batch.column(1).to_numpy()[ok]), pa.array(sim[ok])], ["a", "b", "similarity"])

    right = pairs.join(texts.select(F.col("h").alias("b"), F.col("t").alias("tb")), "b")
    both = right.join(texts.select(F.col("h").alias("a"), F.col("t").alias("ta")), "a").sortWithinPartitions("a")
    return both.select("a", "b", "ta", "tb").mapInArrow(judge, schema)


def prefix_keys(key: np.ndarray, weight: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """A text's rarest features, as many as leave the others less than ``threshold`` of its weight; and its weight.

    Texts that have none of these in common aren't similar: with the rarest
    feature that two texts share left out of one's prefix, they share less
    than ``threshold`` of its weight, which bounds their similarity.
    """
    rare = idf[(key & U(len(idf) - 1)).astype(np.int64)]
    order = np.lexsort((key, -rare))
    total = float(weight.sum(dtype=np.float64))
    before = np.cumsum(weight[order], dtype=np.float64) - weight[order]
    return key[order[total - before >= (threshold - 1e-6) * total]], total


def late_pairs(placed: DataFrame, texts: DataFrame, idf, p: MinHashParams) -> DataFrame:
    """Distinct pairs (a, b) of a bucket, not yet in one group, that could still be near.

    ``placed``: (bucket, h, first, g, fg), g and fg being the groups of h and
    of the bucket's first. In a crowded bucket only such texts make a pair
    that share one of both their prefix features and whose weights are in
    proportion; many texts that have a passage in common, and no more, are
    thus not held against each other.
    """
    member = placed.select("bucket", "h", "first", "g", (F.col("g") != F.col("fg")).alias("apart"))
    load = member.groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("apart"), 1)).alias("n_apart")).filter("n_apart > 0").select("bucket", (F.col("n") * F.col("n_apart") > p.crowd).alias("crowded"))
    member = materialize(member.join(load, "bucket"), "minhash-apart")
    couple = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    x = member.filter("apart").select("bucket", F.col("h").alias("x"), F.col("g").alias("gx"), "first")
    y = member.select("bucket", F.col("h").alias("y"), F.col("g").alias("gy"), "crowded")
    apart = "gx != gy and y != first"
    few = x.join(y.filter("not crowded").drop("crowded"), "bucket").filter(apart).select(*couple)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            found = [(h[row], *prefix_keys(key, weight, idf.value, p.threshold)) for row, key, weight in features(batch.column(1), idf.value, p)]
            offsets = pa.array(np.r_[0, np.cumsum([len(k) for _, k, _ in found])], pa.int32())
            keys = np.concatenate([k for _, k, _ in found]).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in found], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64())), pa.array([w for _, _, w in found], pa.float64())], ["h", "keys", "weight"])

    crowd = member.filter("crowded")
    wanted = crowd.select("h").distinct()
    with arrow_batches(placed.sparkSession, p.batch_rows):
        rare = materialize(texts.join(wanted, "h", "left_semi").select("h", "t").mapInArrow(prefixes, "h long, keys array<long>, weight double"), "minhash-prefixes")
    keyed = crowd.join(rare, "h").select("bucket", F.explode("keys").alias("key"), "h", "first", "g", "apart", "weight")
    kx = keyed.filter("apart").select("bucket", "key", F.col("h").alias("x"), F.col("g").alias("gx"), "first", F.col("weight").alias("wx"))
    ky = keyed.select("bucket", "key", F.col("h").alias("y"), F.col("g").alias("gy"), F.col("weight").alias("wy"))
    in_proportion = F.least("wx", "wy") >= F.greatest("wx", "wy") * F.lit(p.threshold - 1e-6)
    many = kx.join(ky, ["bucket", "key"]).filter(apart).filter(in_proportion).select(*couple)
    return few.unionAll(many).distinct()


def near_duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: MinHashParams = MinHashParams()) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): each row's text hash, id and whether it has a word; and for each text hash of a group of two texts or more, the group's least hash.

    Equal texts share a hash and go through the search once, so thousands of
    exact copies cost one entry. In a bucket each text is held against the
    bucket's first; then, in what did not join the first text's group, each
    text against all texts of the bucket that are not yet in its own group.
    That settles every pair that could still change a group, and keeps large
    groups of copies from costing the square of their size; ``late_pairs``
    keeps texts that merely share a passage from costing it.
    """
    p = params
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("t"))
    with arrow_batches(spark, p.batch_rows):
        df, n = document_frequencies(rows.select("t"), p)
        idf = spark.sparkContext.broadcast(idf_table(df, n, p))
        signed = materialize(_signatures(rows, idf, p), "minhash-signatures")
    contents = signed.filter(F.size("bands") > 0).groupBy("h").agg(F.min("k").alias("k"), F.first("bands").alias("bands"))
    bucket = Window.partitionBy("bucket")
    spread = contents.select("h", "k", F.explode("bands").alias("bucket"))
    members = materialize(
        spread.withColumn("first", F.min("h").over(bucket)).withColumn("n", F.count("*").over(bucket)).filter("n > 1").select("bucket", "h", "k", "first"), "minhash-buckets"
    )
    wanted = members.select("h", "k").distinct()
    texts = materialize(
        rows.join(wanted.hint("shuffle_hash"), (rows.h == wanted.h) & rows.k.eqNullSafe(wanted.k), "left_semi").select("h", "t").dropDuplicates(["h"]), "minhash-texts"
    )
    star = members.filter("h != first").select(F.col("first").alias("a"), F.col("h").alias("b")).distinct()
    with arrow_batches(spark, p.batch_rows):
        near = materialize(_verified(star, texts, idf, p), "minhash-pairs")
    joined = materialize(connected_components(near, "a", "b"), "minhash-joined")
    group_of = joined.select(F.col("node").alias("h"), F.col("component").alias("g"))
    first_of = joined.select(F.col("node").alias("first"), F.col("component").alias("fg"))
    placed = members.join(group_of, "h", "left").join(first_of, "first", "left")
    placed = placed.select("bucket", "h", "first", F.coalesce("g", "h").alias("g"), F.coalesce("fg", "first").alias("fg"))
    more = late_pairs(placed, texts, idf, p)
    with arrow_batches(spark, p.batch_rows):
        late = materialize(_verified(more, texts, idf, p), "minhash-late-pairs")
    groups = connected_components(near.select("a", "b").unionByName(late.select("a", "b")), "a", "b")
    for done in (members, texts, joined):
        discard(done)
    return signed, groups.select(F.col("node").alias("h"), F.col("component").alias("g"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: MinHashParams = MinHashParams()) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the least id.

    Texts are compared in lower case by their words; those with equal texts
    are copies. Where ids tie, the text with the least hash stays; a null id
    comes after all others. Of rows that repeat both id and text, one stays:
    that with the least hash of its columns.
    A null, empty or wordless text resembles nothing and stays. Texts of any
    length are read whole. Other columns, whatever their names, are passed
    on; an empty table gives an empty table.
    """
    signed, groups = near_duplicate_groups(docs, text, doc_id, params)
    group = signed.filter(F.size("bands") > 0).groupBy("h", "k").agg(F.count("*").alias("n")).join(groups, "h", "left").withColumn("g", F.coalesce("g", "h"))
    rank = F.struct(F.col("k").isNull(), F.col("k"), F.col("h"))
    kept = group.groupBy("g").agg(F.min(rank).alias("best"))
    named = group.join(kept, "g").select("h", "k", rank.eqNullSafe(F.col("best")).alias("stays"))
    goes = materialize(named.filter(~F.col("stays")).select("h", "k"), "minhash-dropped")
    repeats = signed.groupBy("h", "k").count().filter("count > 1").select("h", "k")
    some = repeats.limit(1).count() > 0
    h, k, mark = private_name(docs, "__hash"), private_name(docs, "__key"), private_name(docs, "__mark")
    name = lambda c: F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))
    keyed = docs.withColumn(h, F.xxhash64(F.col(f"`{text}`"))).withColumn(k, name(F.col(f"`{doc_id}`")))
    marks = goes.select(F.col("h").alias(h), name(F.col("k")).alias(k), F.lit("goes").alias(mark))
    if not some:
        left = keyed.join(marks.drop(mark).hint("shuffle_hash"), [h, k], "left_anti")
        return left.drop(h, k)
    staying = repeats.join(goes, (repeats.h == goes.h) & repeats.k.eqNullSafe(goes.k), "left_anti")
    marks = marks.unionAll(staying.select(F.col("h").alias(h), name(F.col("k")).alias(k), F.lit("repeats")))
    marked = keyed.join(marks.hint("shuffle_hash"), [h, k], "left")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    row = private_name(marked, "__row")
    one = marked.filter(F.col(mark) == "repeats").withColumn(row, F.row_number().over(Window.partitionBy(h, k).orderBy(F.xxhash64(*plain)))).filter(F.col(row) == 1)
    return marked.filter(F.col(mark).isNull()).drop(h, k, mark).unionAll(one.drop(h, k, mark, row))
