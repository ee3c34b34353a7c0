"""Data-quality checks: each gives the rows that fail it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.hs import SOURCES
from portolan.plans.classify import CHAPTERS


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(column)


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(~F.col(column).between(low, high))


def row_count_between(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).filter(~F.col("n").between(low, high))


def same_row_count(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b"))).filter("n_a != n_b")


def scenario_anchor(mart: DataFrame, expected_pp: float = 25.0, scenario: str = "S232 EU auto", tolerance: float = 0.01) -> DataFrame:
    """Rows of one scenario whose rate or money doesn't add up; and one row if the scenario has none at all."""
    own = mart.filter(F.col("scenario_name") == scenario)
    rate = F.abs(F.col("scenario_duty_rate_pct") - F.col("baseline_duty_rate_pct") - expected_pp)
    money = F.abs(F.col("scenario_landed_cost_usd") - F.col("baseline_landed_cost_usd") - F.col("baseline_value_usd") * expected_pp / 100.0)
    bad = own.filter((rate > 1e-9) | (money > tolerance)).select("scenario_name", F.lit("doesn't add up").alias("problem"))
    missing = own.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(scenario).alias("scenario_name"), F.lit("missing").alias("problem"))
    return bad.unionByName(missing)


@dataclass(frozen=True)
class Check:
    table: str
    column: str
    kind: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    severity: str = "error"
    values: tuple = ()
    parent: tuple[str, str] | tuple[()] = ()

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}.{self.kind}"


def suite() -> list[Check]:
    """The checks of all tables of the full pipeline."""
    out: list[Check] = []

    def add(table: str, column: str, kinds: str, values: Sequence | None = None, parent: tuple[str, str] | None = None, severity: str = "error") -> None:
        for k in kinds.split():
            if k == "unique":
                f = lambda t, table=table, column=column: unique(t[table], column)
            elif k == "not_null":
                f = lambda t, table=table, column=column: not_null(t[table], column)
            elif k == "accepted":
                f = lambda t, table=table, column=column, values=values: accepted_values(t[table], column, values)
            else:
                f = lambda t, table=table, column=column, parent=parent: relationships(t[table], column, t[parent[0]], parent[1])
            out.append(Check(table, column, k, f, severity if k == "related" else "error", tuple(values or ()) if k == "accepted" else (), parent or () if k == "related" else ()))

    for p in ("supplier", "consignee"):
        add(f"silver_{p}_golden", f"golden_{p}_id", "unique not_null")
        add(f"silver_{p}_golden", "canonical_name", "not_null")
        add(f"int_{p}_pair_scored", "match_label", "accepted", ["match", "review", "no_match"])
        norm = "shipper" if p == "supplier" else "consignee"
        add(f"int_{p}_name_normalized", f"{norm}_name_norm", "not_null")
        add(f"int_{p}_name_normalized", "is_placeholder", "accepted", [True, False])
        for table in ("silver_bol_shipments", "silver_bol_shipments_scoped"):
            add(table, f"golden_{p}_id", "not_null related" if table == "silver_bol_shipments" else "related", parent=(f"silver_{p}_golden", f"golden_{p}_id"))
        add("silver_bol_shipments_classified", f"golden_{p}_id", "not_null")
        add(f"dim_{p}", f"{p}_key", "unique not_null")
        add("fact_shipments", f"{p}_key", "not_null related", parent=(f"dim_{p}", f"{p}_key"))
    for table in ("silver_bol_shipments", "silver_bol_shipments_classified"):
        add(table, "identifier", "not_null")
        add(table, "container_number", "not_null")
    add("silver_bol_shipments", "consignee_party_type", "accepted", ["freight_forwarder", "importer"])
    add("silver_bol_shipments_classified", "hs_source_final", "accepted", SOURCES)
    add("silver_bol_shipments_scoped", "hs_code_unified", "not_null")
    add("silver_bol_shipments_scoped", "hs_2_final", "not_null accepted", CHAPTERS)
    add("dim_ticker", "ticker", "unique not_null")
    add("dim_ticker", "filing_type_latest", "not_null accepted", ["10-K", "20-F"])
    add("dim_ticker", "match_confidence", "accepted", ["exact", "partial", "none"])
    add("fact_10k_risk_chunks", "chunk_id", "unique not_null")
    for table, key in (("dim_country", "country_code"), ("dim_hs_code", "hs_6"), ("dim_date", "date_key"), ("fact_shipments", "shipment_key")):
        add(table, key, "unique not_null")
    add("fact_tariff_events", "date_key", "not_null")
    add("fact_tariff_events", "rate_change_pp", "not_null")
    add("fact_tariff_events", "event_type", "accepted", ["section_232", "section_301", "other"])
    add("tariff_events", "event_type", "not_null accepted", ["section_232", "section_301"])
    add("tariff_events", "event_date", "not_null")
    add("tariff_events", "rate_change_pp", "not_null")
    for seed, column in (("hs_eval_seed", "product_description"), ("hs_eval_seed_v2", "product_text")):
        add(seed, column, "not_null")
        add(seed, "correct_hs_6", "not_null")
    add("dim_ticker", "cik", "not_null")
    add("fact_10k_risk_chunks", "ticker", "not_null")
    add("fact_10k_risk_chunks", "chunk_text", "not_null")
    add("fact_shipments", "hs_6", "not_null related", parent=("dim_hs_code", "hs_6"), severity="warn")
    add("fact_shipments", "origin_country_code", "not_null related", parent=("dim_country", "country_code"))
    add("fact_shipments", "date_key", "not_null related", parent=("dim_date", "date_key"))
    add("mart_concentration_metrics", "consignee_key", "not_null related", parent=("dim_consignee", "consignee_key"))
    add("mart_concentration_metrics", "hs_6", "not_null related", parent=("dim_hs_code", "hs_6"), severity="warn")
    for c in ("consignee_key", "scenario_name", "hs_chapter", "origin_country"):
        add("mart_scenario_examples", c, "not_null")
    out.append(Check("fact_10k_risk_chunks", "chunk_length", "range", lambda t: between(t["fact_10k_risk_chunks"], "chunk_length", 200, 1700)))
    out.append(Check("fact_10k_risk_chunks", "*", "row_count", lambda t: row_count_between(t["fact_10k_risk_chunks"], 1000, 3000)))
    out.append(Check("silver_bol_shipments_classified", "*", "row_count", lambda t: same_row_count(t["silver_bol_shipments_classified"], t["silver_bol_shipments"])))
    out.append(Check("mart_scenario_examples", "*", "anchor", lambda t: scenario_anchor(t["mart_scenario_examples"])))
    out.append(Check("mart_scenario_examples", "*", "row_count", lambda t: row_count_between(t["mart_scenario_examples"], 10, 200)))
    return out


def run_suite(tables: dict[str, DataFrame], checks: Sequence[Check] | None = None) -> DataFrame:
    """(check_name, severity, n_failed) of every check whose tables are there, as one plan."""
    parts = []
    for c in checks if checks is not None else suite():
        try:
            failed = c.run(tables)
        except KeyError:
            continue
        parts.append(failed.agg(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"), F.count("*").alias("n_failed")))
    if not parts:
        raise ValueError("no check has its tables")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
