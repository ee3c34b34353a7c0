"""One query per operator, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm import bitpack, chat, hnsw, links, minhash, mixing, packing, pii, quality, warc
from portolan.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=True)
    return out.withColumn("keep_probability", F.round("keep_probability", 6)).withColumn("mix_weight", F.round("mix_weight", 6))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op5_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links.filter_urls(_table(spark, sf_dir, "pages"))
    return out.withColumn("trust", F.round("trust", 6)).withColumn("distrust", F.round("distrust", 6))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_conversations(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("generated", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("conversation not rendered: "), "error"))).otherwise(F.col("text"))  # the SQL has no column for it
    return out.select("conv_id", "n_messages", whole.alias("text"), spans.alias("generated"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask_pii(_table(spark, sf_dir, "documents"), spans="pii_spans")


def op10_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.pack_documents(_table(spark, sf_dir, "documents"))


_ALL = (op1_quality_rules, op2_source_mixing, op3_packing, op4_warc, op5_hnsw_near_dedup, op6_url_filter, op7_minhash_near_dedup, op8_chat_format, op9_pii, op10_token_bits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.clean_lines_sql(),
        "op2_source_mixing": mixing.mix_sources_sql(),
        "op4_warc": warc.ROUND_TRIP_SQL,
        "op6_url_filter": links.filter_urls_sql(),
        "op8_chat_format": chat.chatml_sql(),
    }
