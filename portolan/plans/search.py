"""Ranked retrieval of text chunks with attribute filters.

The score blends BM25 over words with the cosine of hashed n-gram vectors.
Words and lengths are written once when the index is built; a query touches
the postings of its own words and the vectors of the rows its filter leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.vector import HashedNgrams, dot, embed
from portolan.session import arrow_batches, ship_code
from portolan.sources.tables import append_new, read_if_exists, replace_table

K1, B = 1.2, 0.75
BUCKETS = 64  # of words; a query reads those of its own words


def words(text):
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.length(w) > 1)


@dataclass
class SearchIndex:
    """Documents with their vectors and lengths, and postings (bucket, word, key, tf)."""

    documents: DataFrame
    postings: DataFrame
    key: str
    text: str
    embedder: object = None
    _size: tuple[int, float] | None = None

    def size(self) -> tuple[int, float]:
        """Documents and their mean length in words, counted once for each index."""
        if self._size is None:
            n, mean = self.documents.agg(F.count("*"), F.avg("n_words")).first()
            self._size = n, mean or 0.0
        return self._size

    def search(self, query: str, k: int = 10, columns: Sequence[str] | None = None, eq: dict[str, object] | None = None, blend: float = 0.5) -> DataFrame:
        """The ``k`` best rows with ``score``; ties by key. ``eq``: attributes with the values they must have."""
        docs = self.documents
        for name, value in (eq or {}).items():
            docs = docs.filter(F.col(name) == F.lit(value))
        terms = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if len(w) > 1})
        vec = (self.embedder or HashedNgrams())([query])[0].tolist()
        qv = F.array(*[F.lit(float(x)) for x in vec])
        cos = F.coalesce(dot(F.col("embedding"), qv), F.lit(0.0))
        if terms:
            n, mean = self.size()
            hits = self.postings.filter(F.col("bucket").isin([_bucket(F.lit(t)) for t in terms]) & F.col("word").isin(terms))
            df = hits.groupBy("word").agg(F.count("*").alias("__df"))  # a row for each word of the query
            weighed = hits.join(F.broadcast(df), "word")
            idf = F.log1p((F.lit(float(n)) - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
            part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.lit(mean or 1.0)))
            bm = weighed.groupBy(self.key).agg(F.sum(part).alias("bm25"))
            docs = docs.join(bm, self.key, "left")
        else:
            docs = docs.withColumn("bm25", F.lit(0.0))
        bm25 = F.coalesce("bm25", F.lit(0.0))
        # A fixed squashing keeps scores comparable between queries.
        score = F.lit(blend) * bm25 / (bm25 + 5.0) + F.lit(1 - blend) * cos
        out = docs.withColumn("score", score).orderBy(F.col("score").desc(), F.col(self.key).asc()).limit(k)
        return out.select(*(columns or [self.key, self.text]), "score")


def _index_rows(docs: DataFrame, text: str, embedder) -> DataFrame:
    return docs.withColumn("embedding", embed(embedder)(F.col(text))).withColumn("n_words", F.size(words(F.col(text))).cast("long"))


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    counted = docs.select(key, "n_words", F.explode(words(F.col(text))).alias("word")).groupBy(key, "n_words", "word").agg(F.count("*").alias("tf"))
    return counted.withColumn("bucket", _bucket(F.col("word")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_words, word, tf) of documents (key, n_words, words), each counted where it lies."""
    for b in batches:
        at, coded = pc.list_parent_indices(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64), b.column(2).flatten().dictionary_encode()
        many = max(1, len(coded.dictionary))
        pairs, tf = np.unique(at * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        rows = pa.array(pairs // many)
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), coded.dictionary.take(pa.array(pairs % many)), pa.array(tf.astype(np.int64))], ["key", "n_words", "word", "tf"])


def _postings_of_unique(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings of documents with one row per key: nothing is added up over rows, so the words are shuffled once, into pieces of a bucket each, and no task holds a table of them."""
    rows = docs.select(F.col(key).alias("key"), F.col("n_words").cast("long").alias("n_words"), words(F.col(text)).alias("words"))
    out = rows.mapInArrow(_counted, T.StructType([rows.schema["key"], rows.schema["n_words"], T.StructField("word", T.StringType()), T.StructField("tf", T.LongType())]))
    out = out.select(F.col("key").alias(key), "n_words", "word", "tf", _bucket(F.col("word")).alias("bucket"))
    return out.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(16)))


def build_index(docs: DataFrame, key: str, text: str, path: str | None = None, embedder=None) -> SearchIndex:
    """An index over ``docs``; with ``path``, kept there, and a later call adds the rows with new keys alone."""
    ship_code(docs.sparkSession)
    if path is None:
        rows = _index_rows(docs, text, embedder)
        return SearchIndex(rows, _postings(rows, key, text), key, text, embedder)
    spark = docs.sparkSession
    before = read_if_exists(spark, f"{path}/documents")
    fresh = docs.dropDuplicates([key]) if before is None else docs.dropDuplicates([key]).join(before.select(key), key, "left_anti")
    stored = replace_table(_index_rows(fresh, text, embedder), f"{path}/fresh")
    with arrow_batches(spark, 1000):
        append_new(_postings_of_unique(stored, key, text), f"{path}/postings", [key, "word"], partition_by=["bucket"], unique=True)
    rows = append_new(stored, f"{path}/documents", [key])
    return SearchIndex(rows, spark.read.parquet(f"{path}/postings"), key, text, embedder)


def search_risk_factors(index: SearchIndex, ticker: str, question: str = "tariff exposure", limit: int = 3) -> DataFrame:
    """What one company's filings say."""
    return index.search(question, limit, ["chunk_text", "ticker", "filing_year"], {"ticker": ticker})
