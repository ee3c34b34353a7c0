"""The star schema and the concentration mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portolan.functions import hs, money
from portolan.functions.text import is_freight_forwarder
from portolan.operators.relational import shortest_by, text_chunks, top_by
from portolan.plans.entities import Party


def dim_party(golden: DataFrame, party: Party) -> DataFrame:
    """Suppliers or consignees; whether one is a forwarder is judged by its canonical name."""
    n = party.name
    return golden.select(F.col(party.golden_id).alias(f"{n}_key"), F.col("canonical_name").alias(f"{n}_name"), F.col("country").alias(f"{n}_country_code"), "raw_name_variants_count", "total_shipments", is_freight_forwarder(F.col("canonical_name")).alias("is_forwarder"), "sample_address")


_QUOTA = "Section 232 steel/aluminum quota exemption"
_COUNTRIES = {
    "AFRICA": "LR:Liberia ZA:South_Africa",
    "ASIA": "CN:China HK:Hong_Kong ID:Indonesia IN:India JP:Japan KR:South_Korea MY:Malaysia PH:Philippines SG:Singapore TH:Thailand TW:Taiwan VN:Vietnam",
    "EU": "AT:Austria BE:Belgium CH:Switzerland CZ:Czech_Republic DE:Germany DK:Denmark ES:Spain FI:Finland FR:France GB:United_Kingdom IT:Italy NL:Netherlands NO:Norway PL:Poland PT:Portugal SE:Sweden",
    "LATAM": "AR:Argentina BR:Brazil CL:Chile CO:Colombia",
    "MIDDLE_EAST": "AE:United_Arab_Emirates BH:Bahrain KW:Kuwait QA:Qatar SA:Saudi_Arabia TR:Turkey",
    "NORTH_AMERICA": "CA:Canada MX:Mexico US:United_States",
    "OCEANIA": "AU:Australia",
}
_NO_232 = frozenset("AR AU BR CA MX".split())


def country_rows() -> list[tuple]:
    notes = {c: _QUOTA for c in _NO_232} | {"CN": "Section 301 tariff target", "LR": "Major flag-of-convenience shipping registry"}
    return [(code, name.replace("_", " "), region, code not in _NO_232, code == "CN", notes.get(code)) for region, names in _COUNTRIES.items() for code, name in (x.split(":") for x in names.split())]


def dim_country(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(country_rows(), "country_code string, country_name string, region string, is_section_232_target boolean, is_section_301_target boolean, notes string")


def dim_date(spark: SparkSession, first: str = "2013-01-01", last: str = "2026-12-31") -> DataFrame:
    d = F.col("date_day")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_day"))
    parts = {"year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "day": F.dayofmonth(d)}
    return days.select(
        d.alias("date_key"), d, *[x.cast("long").alias(k) for k, x in parts.items()], F.date_format(d, "EEE").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d)).alias("fiscal_quarter_label"),
    )


def dim_hs_code(hts: DataFrame) -> DataFrame:
    """One row per code with its average duty in percent, the shortest description of each level, and additional rates."""
    rate = hts.filter(F.col("hs6").isNotNull()).groupBy("hs6", "hs4", "hs2").agg((F.avg("ad_valorem_rate") * 100).alias("general_duty_rate_pct"))
    for k in ("hs6", "hs4", "hs2"):
        rate = rate.join(shortest_by(hts, k, "description", "hts_number").withColumnRenamed("description", f"d_{k}"), k, "left")
    levels = [x for k in (6, 4, 2) for x in (F.col(f"hs{k}").alias(f"hs_{k}"), F.col(f"d_hs{k}").alias(f"hs_{k}_description"))]
    return rate.select(*levels, "general_duty_rate_pct", hs.chapter_rate(F.col("hs2"), hs.SECTION_232).alias("section_232_rate_pct"), hs.chapter_rate(F.col("hs2"), hs.SECTION_301).alias("section_301_rate_pct"))


#: Companies by ticker, legal form after the bar.
_COMPANIES = """
VFC VF Corporation|WMT Walmart Inc.|WDC Western Digital Corporation|TTM Tata Motors Limited|TPR Tapestry, Inc.|RL Ralph Lauren Corporation|PVH PVH Corp.|PH Parker Hannifin Corporation
NVDA NVIDIA Corporation|NKE Nike, Inc.|MU Micron Technology, Inc.|LULU Lululemon Athletica Inc.|LEVI Levi Strauss & Co.|JNPR Juniper Networks, Inc.|HPQ HP Inc.|HBI HanesBrands Inc.
GES Guess?, Inc.|ETN Eaton Corporation plc|DE Deere & Company|CSCO Cisco Systems, Inc.|CAT Caterpillar Inc.|ANET Arista Networks, Inc.|AMD Advanced Micro Devices, Inc.|AAPL Apple Inc.
"""


def company_rows() -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for line in _COMPANIES.strip().splitlines() for c in line.split("|")]


def dim_ticker(filings: DataFrame, consignees: DataFrame) -> DataFrame:
    """Each known ticker's latest filing and the consignee that fits its company best: equal names, else one that has the company's first word, by shipments."""
    spark = filings.sparkSession
    latest = top_by(filings.filter(F.col("item_1a_text").isNotNull()), ["ticker"], [F.col("filing_date").desc_nulls_last(), F.col("cik").asc_nulls_last()])
    company = spark.createDataFrame(company_rows(), "ticker string, company_name string")
    token = F.upper(F.regexp_replace(F.split_part("company_name", F.lit(" "), F.lit(1)), "[^A-Za-z0-9]", ""))
    name = F.upper("canonical_name")
    pairs = F.broadcast(company.withColumn("t", token)).join(consignees.select("golden_consignee_id", "canonical_name", "total_shipments"), name.contains(F.col("t")))
    exact = name == F.upper("company_name")
    best = top_by(pairs, ["ticker"], [F.when(exact, 0).otherwise(1).asc(), F.col("total_shipments").desc_nulls_last(), F.col("golden_consignee_id").asc()])
    found = best.select("ticker", F.col("golden_consignee_id").alias("matched_consignee_key"), F.when(exact, "exact").otherwise("partial").alias("m"))
    return (
        latest.join(company, "ticker")
        .join(found, "ticker", "left")
        .select(
            "ticker", "company_name", "cik", F.col("filing_type").alias("filing_type_latest"), F.col("filing_date").alias("filing_date_latest"), F.col("item_1a_length").alias("item_1a_length_latest"),
            (F.col("item_1a_length") >= 5000).alias("is_supply_chain_relevant"), "matched_consignee_key", F.coalesce("m", F.lit("none")).alias("match_confidence"),
        )
    )


def fact_shipments(scoped: DataFrame, hs_codes: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per shipment with weight, duty and landed cost; a code or country that isn't known adds no duty."""
    ships = scoped.withColumn("hs_6", hs.hs6(F.col("hs_code_unified")))
    rates = hs_codes.select("hs_6", "general_duty_rate_pct", "section_232_rate_pct", "section_301_rate_pct")
    flags = countries.select(F.col("country_code").alias("shipment_origin_country"), "is_section_232_target", "is_section_301_target")
    # Countries are a fixed list; tariff codes are left to adaptive execution.
    joined = ships.join(rates, "hs_6", "left").join(F.broadcast(flags), "shipment_origin_country", "left")
    duty = money.effective_duty_pct(*[F.col(c) for c in ("general_duty_rate_pct", "section_232_rate_pct", "section_301_rate_pct", "is_section_232_target", "is_section_301_target")])
    joined = joined.withColumn("effective_duty_rate_pct", duty)
    return joined.select(
        F.md5(F.concat(F.col("identifier").cast("string"), F.lit("|"), "container_number")).alias("shipment_key"), F.col("identifier").alias("bol_identifier"), "container_number", F.col("trade_update_date").alias("date_key"),
        F.col("golden_supplier_id").alias("supplier_key"), F.col("golden_consignee_id").alias("consignee_key"), "hs_6", F.col("shipment_origin_country").alias("origin_country_code"),
        money.weight_kg(F.col("harmonized_weight"), F.col("harmonized_weight_unit")).alias("weight_kg"), F.col("harmonized_value").alias("shipment_value_usd"), "piece_count", "hs_source_final", "consignee_party_type",
        "general_duty_rate_pct", "section_232_rate_pct", "section_301_rate_pct", "effective_duty_rate_pct", money.landed_cost(F.col("harmonized_value"), F.col("effective_duty_rate_pct")).alias("estimated_landed_cost_usd"),
    )


def fact_tariff_events(events: DataFrame) -> DataFrame:
    """The events with a running key. A dozen rows by nature, so one partition numbers them."""
    order = W.orderBy(*[F.col(c).asc_nulls_last() for c in ("event_date", "event_type", "hs_scope", "country_scope", "description")])
    return events.select(F.row_number().over(order).cast("long").alias("event_key"), F.col("event_date").alias("date_key"), *[c for c in events.columns if c != "event_date"])


def fact_10k_risk_chunks(filings: DataFrame) -> DataFrame:
    """Overlapping chunks of the risk sections."""
    have = filings.select("ticker", "cik", "filing_type", F.year("filing_date").cast("long").alias("filing_year"), "filing_date", "item_1a_text")
    cut = text_chunks(have, "item_1a_text")
    key = F.md5(F.concat("ticker", F.lit("|"), F.col("filing_date").cast("string"), F.lit("|"), F.col("chunk_start").cast("string")))
    return cut.select(key.alias("chunk_id"), "ticker", "cik", "filing_type", "filing_year", "filing_date", "chunk_start", "chunk_end", "chunk_length", "chunk_text")


SINGLE = 0.70


def mart_concentration_metrics(fact: DataFrame, consignee: str = "consignee_key", code: str = "hs_6", supplier: str = "supplier_key", country: str = "origin_country_code", weight: str = "weight_kg", landed: str = "estimated_landed_cost_usd") -> DataFrame:
    """Concentration of each (consignee, code) on suppliers and countries, by shipment counts.

    Supplier shares are those of (supplier, country), so one that ships from
    two countries counts as two holders; for the index over suppliers alone
    see ``operators.relational.hhi``. Each row counts for its (supplier,
    country), its supplier and its country; these are summed up in one shuffle,
    where a large group is in many tasks, and the groups' figures, which are
    sums and maxima over holders, in a second one of few rows.
    """
    keys = [consignee, code]
    s, k, w, c = (F.col(x) for x in (supplier, country, weight, landed))
    kinds = fact.schema
    none = lambda x: F.lit(None).cast(kinds[x].dataType)
    as_row = lambda kind, *values: F.struct(F.lit(kind).alias("kind"), *[v.alias(n) for v, n in zip(values, "skwc")])
    each = F.array(as_row(0, s, k, w, c), as_row(1, s, none(country), none(weight), none(landed)), as_row(2, none(supplier), k, none(weight), none(landed)))
    rows = fact.select(*keys, F.inline(each).alias("__kind", "__s", "__k", "__w", "__c"))
    base = rows.groupBy(*keys, "__kind", "__s", "__k").agg(F.count("*").alias("n"), F.sum("__w").alias("w"), F.sum("__c").alias("c"))
    of = lambda kind, x: F.when(F.col("__kind") == kind, x)
    n = F.col("n").cast("double")
    held = base.groupBy(*keys).agg(
        F.count(of(1, F.col("__s"))).alias("supplier_count"), F.count(of(2, F.col("__k"))).alias("country_count"), F.sum(of(0, F.col("n"))).alias("total_shipment_count"), F.sum(of(0, F.col("w"))).alias("total_weight_kg"), F.sum(of(0, F.col("c"))).alias("total_landed_cost_usd"),
        *[f(of(kind, x)).alias(name) for kind, who in ((0, "s"), (2, "k")) for f, x, name in ((F.sum, n * n, f"__{who}2"), (F.max, n, f"__{who}m"))],
    )
    total = F.col("total_shipment_count").cast("double")
    out = held.select(
        *keys, "supplier_count", "country_count", "total_shipment_count", "total_weight_kg", "total_landed_cost_usd",
        (F.col("__s2") / (total * total)).alias("supplier_hhi"), (F.col("__sm") / total).alias("top_supplier_share"), (F.col("__k2") / (total * total)).alias("country_hhi"), (F.col("__km") / total).alias("top_country_share"),
    )
    return out.withColumn("is_single_source", F.col("top_supplier_share") > SINGLE).withColumn("is_single_country", F.col("top_country_share") > SINGLE)
