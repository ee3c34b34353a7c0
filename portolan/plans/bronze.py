"""Typed, deduplicated raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions import hs
from portolan.operators.relational import latest_by


def bronze_bol(raw: DataFrame) -> DataFrame:
    """Real bills with a container, the latest of each (identifier, container), and the best code there is without a model."""
    real = raw.filter(~hs.is_sentinel_identifier(F.col("identifier")) & (F.trim("container_number") != ""))
    one = latest_by(real, ["identifier", "container_number"], "trade_update_date")
    code, source = hs.declared_or_text(F.col("harmonized_number"), F.col("text"))
    kept = [c for c in one.columns if c != "ingested_at"]
    return one.select(*kept, code.alias("harmonized_number_final"), source.alias("hs_source"), *[c for c in one.columns if c == "ingested_at"])


def bronze_hts(raw: DataFrame) -> DataFrame:
    """The latest row of each tariff number with its rate. All rows without a number count as one number."""
    one = latest_by(raw, ["hts_number"], "ingested_at")
    rate = F.col("general_rate_text")
    kept = [c for c in one.columns if c != "ingested_at"]
    return one.select(*kept, hs.ad_valorem_rate(rate).alias("ad_valorem_rate"), hs.specific_rate(rate).alias("specific_rate_raw"), "ingested_at")


def bronze_10k(raw: DataFrame) -> DataFrame:
    """The latest row of each (cik, filing date); relevant if its risk section has 5,000 characters."""
    one = latest_by(raw, ["cik", "filing_date"], "ingested_at")
    return one.withColumn("filing_type", F.coalesce("filing_type", F.lit("10-K"))).withColumn("is_supply_chain_relevant", F.col("item_1a_length") >= 5000)
