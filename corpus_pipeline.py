"""documents, cleaned, deduplicated, masked, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portolan.llm import minhash, mixing, packing, pii, quality
from portolan.session import discard, materialize, spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("personal data", mask_personal_data), ("source mixing", mix_sources), ("packing", pack_windows)]

#: Near-dedup and the network can't be said in SQL; tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
            discard(before)  # what the stage before left; the documents themselves aren't touched
    return docs
