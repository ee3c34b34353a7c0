"""Looking at the raw data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.country import extract_country_from_text, port_origin_country, port_suffix
from portolan.functions.hs import SIX, ad_valorem_rate
from portolan.functions.text import eda_canon, full_match, keyword_count, token_set_ratio
from portolan.operators.relational import exact_sample, running_share, top_by
from portolan.session import ship_code
from portolan.sources.tables import load_summary

RISK_WORDS = ("tariff", "supply chain", "china", "import", "duties", "trade war", "sourcing", "single source", "customs", "mexico", "vietnam", "section 301")


def overview(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.min(date).alias("first"), F.max(date).alias("last"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """One row per column: rows looked at, nulls and their share, in one pass. ``sample``: exact number of random rows to look at."""
    cols = list(columns or df.columns)
    rows = exact_sample(df.select(*cols), sample, seed) if sample else df
    wide = rows.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = wide.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_null")) for c in cols])).alias("x"))
    return long.select("x.column_name", F.col("__n").alias("n_rows"), "x.n_null", (F.col("x.n_null") / F.nullif(F.col("__n"), F.lit(0))).alias("null_share"))


def full_null_profile(df: DataFrame, exact: Sequence[str], sample: int = 100_000) -> DataFrame:
    """Exact on some columns, on a sample for the rest."""
    rest = [c for c in df.columns if c not in exact]
    return null_profile(df, exact).unionByName(null_profile(df, rest, sample)) if rest else null_profile(df, exact)


def hs_gap(bol: DataFrame) -> DataFrame:
    """One row: rows with and without a declared code, and of those without, how many have one in the text or could have."""
    none = F.coalesce(F.trim("harmonized_number"), F.lit("")) == ""
    text = F.coalesce("text", F.lit(""))
    explicit = none & full_match(text, rf"(?s:.*)HS[ -]?CODE:?\s*{SIX}(?s:.*)", ignore_case=True)
    return bol.agg(F.count("*").alias("n_rows"), F.count_if(~none).alias("declared"), F.count_if(none).alias("missing"), F.count_if(explicit).alias("recoverable"), F.count_if(none & ~explicit & (F.length(F.trim(text)) >= 5)).alias("has_text"), F.count_if(none & (F.trim(text) == "")).alias("no_text"))


def pareto(df: DataFrame, key: str, shares: Sequence[float] = (0.01, 0.10, 0.50)) -> DataFrame:
    """What share of the rows the most frequent 1, 10 and 50 per cent of keys have: (top_share, n_keys, row_share)."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    ranked = running_share(counts, "n", key)
    total = counts.agg(F.count("*").alias("k"))
    cut = total.select("k", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("top_share")).withColumn("n_keys", F.greatest(F.lit(1), F.floor(F.col("k") * F.col("top_share"))).cast("long"))
    return ranked.join(F.broadcast(cut), F.col("rank") == F.col("n_keys")).select("top_share", "n_keys", F.col("running_share").alias("row_share"))


def name_variation(df: DataFrame, name: str) -> DataFrame:
    """One row: distinct raw names, distinct canonical ones, and their ratio."""
    d = df.filter(F.col(name).isNotNull()).select(name).distinct()
    return d.agg(F.count("*").alias("raw_names"), F.countDistinct(eda_canon(F.col(name))).alias("canonical_names")).withColumn("ratio", F.col("raw_names") / F.nullif(F.col("canonical_names"), F.lit(0)))


def name_variants(df: DataFrame, name: str, most: int = 20) -> DataFrame:
    """The canonical names with most variants, and these."""
    d = df.filter(F.col(name).isNotNull()).select(name).distinct().withColumn("canon", eda_canon(F.col(name)))
    return d.groupBy("canon").agg(F.count("*").alias("n_variants"), F.array_sort(F.collect_list(name)).alias("variants")).orderBy(F.desc("n_variants"), "canon").limit(most)


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """How often each value of ``row`` occurs with each of ``values``; 0 where never."""
    t = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return t.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(v) for v in values])


def top_values(df: DataFrame, value: Column, n: int = 15, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(name).asc_nulls_last()).limit(n)


def duplicate_ids(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), key).limit(n)


def sentinel_ids(df: DataFrame, key: str, modulus: int = 1_000_000) -> DataFrame:
    """Repeated ids that end in zeros, which real ones hardly do."""
    return df.filter(F.col(key) % modulus == 0).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count(column).alias("n_known")).withColumn("share", F.col("n_known") / F.nullif(F.col("n_rows"), F.lit(0)))


def indent_histogram(hts: DataFrame) -> DataFrame:
    return hts.groupBy("indent").agg(F.count("*").alias("n")).orderBy(F.col("indent").asc_nulls_first())


def rate_coverage(hts: DataFrame) -> DataFrame:
    """One row: rates that are free, a share of the value, specific, or missing."""
    t = F.coalesce(F.trim("general_rate_text"), F.lit(""))
    rate = ad_valorem_rate(F.col("general_rate_text"))
    return hts.agg(F.count("*").alias("n_rows"), F.count_if(t == "Free").alias("free"), F.count_if(rate > 0).alias("ad_valorem"), F.count_if((t != "") & rate.isNull()).alias("specific"), F.count_if(t == "").alias("missing"))


def footnote_flags(hts: DataFrame) -> DataFrame:
    """Rows whose footnotes name additional duties, by heading 9903.xx."""
    rows = hts.filter(F.col("footnotes").ilike("%9903.%"))
    return rows.groupBy(F.regexp_substr("footnotes", F.lit(r"9903\.\d{2}")).alias("heading")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "heading")


def rate_quantiles(hts: DataFrame, points: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    rows = hts.select(ad_valorem_rate(F.col("general_rate_text")).alias("r")).filter("r is not null")
    return rows.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.max("r").alias("max"), *[F.expr(f"percentile(r, {p})").alias(f"p{int(p * 100)}") for p in points])


def chapter_rates(hts: DataFrame) -> DataFrame:
    """Per chapter the average of positive rates and the share of free lines; chapters with one of them only are there too."""
    rows = hts.filter(F.col("hs2").isNotNull()).select("hs2", ad_valorem_rate(F.col("general_rate_text")).alias("r"))
    mean = rows.filter("r > 0").groupBy("hs2").agg(F.avg("r").alias("avg_rate"))
    free = rows.groupBy("hs2").agg(F.avg(F.when(F.col("r") == 0, 1.0).otherwise(0.0)).alias("free_share"))
    return mean.join(free, "hs2", "outer").orderBy("hs2")


def risk_density(filings: DataFrame, text: str, key: str, keywords: Sequence[str] = RISK_WORDS) -> DataFrame:
    """Per text the count of each risk word, and of all of them per 10,000 characters."""
    names = [w.replace(" ", "_") for w in keywords]
    df = filings.select(key, F.length(text).cast("long").alias("n_chars"), *[keyword_count(F.col(text), w).alias(n) for w, n in zip(keywords, names)])
    total = sum((F.col(n) for n in names), F.lit(0))
    return df.withColumn("total", total.cast("long")).withColumn("per_10k", F.col("total") * 10000.0 / F.nullif(F.col("n_chars"), F.lit(0)))


def fuzzy_companies(names: DataFrame, name: str, companies: DataFrame, company: str, least: float = 85.0, fold: bool = False) -> DataFrame:
    """The best company for each name by token-set ratio, if that is at least ``least``. Companies are a short list and are broadcast after a look at their number."""
    ship_code(names.sparkSession)
    small = companies.select(company)
    if small.limit(100_001).count() <= 100_000:
        small = F.broadcast(small)
    pairs = names.select(name).distinct().crossJoin(small).withColumn("ratio", token_set_ratio(F.col(name), F.col(company), fold))
    return top_by(pairs.filter(F.col("ratio") >= least), [name], [F.desc("ratio"), F.col(company).asc()])


def naive_exposure(bol: DataFrame, hts: DataFrame, by: str) -> DataFrame:
    """Value times the chapter's average duty, summed."""
    mean = hts.filter(F.col("hs2").isNotNull()).select("hs2", ad_valorem_rate(F.col("general_rate_text")).alias("r")).groupBy("hs2").agg(F.avg("r").alias("avg_rate"))
    rows = bol.filter(F.col("harmonized_value").isNotNull() & F.col("harmonized_number").isNotNull()).withColumn("hs2", F.left("harmonized_number", F.lit(2)))
    joined = rows.join(mean, "hs2", "left")
    return joined.groupBy(by).agg(F.count("*").alias("n"), F.sum("harmonized_value").cast("double").alias("value"), F.sum(F.col("harmonized_value") * F.coalesce("avg_rate", F.lit(0.0))).alias("exposure")).orderBy(F.col("exposure").desc_nulls_last(), by)


def ports_by_country(bol: DataFrame) -> DataFrame:
    return top_values(bol, port_suffix(F.col("foreign_port_of_lading")), 50, "country")


def port_origins(bol: DataFrame) -> DataFrame:
    """Shipments by port and consignee's address, with the countries of both; each pair is looked at once, not each shipment."""
    pairs = bol.groupBy(F.col("foreign_port_of_lading").alias("port"), F.col("consignee_address").alias("address")).agg(F.count("*").alias("n"))
    return pairs.select("port", port_origin_country(F.col("port")).alias("origin"), extract_country_from_text(F.col("address")).alias("registered"), "address", "n")


def raw_checks(bol: DataFrame, hts: DataFrame, filings: DataFrame) -> dict[str, DataFrame]:
    """What to look at after a load: rows and dates per table, the largest consignees, rows per chapter, and the filings."""
    return {
        "summary": load_summary({"bol_shipments": (bol, "trade_update_date"), "hts_tariff_schedule": (hts, None), "sec_10k_filings": (filings, "filing_date")}),
        "consignees": top_values(bol.filter(F.col("consignee_name").isNotNull()), F.col("consignee_name"), 10, "consignee_name"),
        "chapters": hts.groupBy("hs2").agg(F.count("*").alias("n")).orderBy(F.col("hs2").asc_nulls_last()),
        "filings": filings.select("ticker", "filing_type", "filing_date", "item_1a_length", "item_7_length").orderBy("ticker", "filing_date"),
    }


def in_scope(bol: DataFrame, chapters: Sequence[str], countries: Column) -> DataFrame:
    return bol.agg(F.count("*").alias("n_rows"), F.count_if(F.left("harmonized_number", F.lit(2)).isin(*chapters) & countries).alias("in_scope"))
