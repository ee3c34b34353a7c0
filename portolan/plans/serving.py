"""What the dashboards ask. Each function takes tables and gives a DataFrame; only the ones that say so fetch a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.operators.relational import hhi, pivot_matrix
from portolan.plans.agent import USD_PER_CREDIT, Agent, log_trace
from portolan.plans.classify import CHAPTERS
from portolan.plans.scenario import Scenario, simulate_tariff_scenario

CHAPTER_NAMES = {"39": "Plastics", "61": "Apparel, knit", "62": "Apparel, woven", "73": "Iron and steel articles", "84": "Machinery", "87": "Vehicles"}


def top_consignees_by_landed_cost(fact: DataFrame, consignees: DataFrame, limit: int = 10) -> DataFrame:
    cost = fact.groupBy("consignee_key").agg(F.sum("estimated_landed_cost_usd").alias("c"))
    named = cost.join(consignees.select("consignee_key", "consignee_name"), "consignee_key").groupBy("consignee_name").agg(F.sum("c").alias("total_landed_cost"))
    return named.orderBy(F.col("total_landed_cost").desc_nulls_last(), "consignee_name").limit(limit)


def _top(consignees: DataFrame, n: int) -> DataFrame:
    return consignees.orderBy(F.col("total_shipments").desc_nulls_last(), "consignee_key").limit(n).select("consignee_key", "consignee_name")


def concentration_cells(fact: DataFrame, consignees: DataFrame, top_n: int = 30) -> DataFrame:
    """(consignee_name, hs_2, supplier_hhi) of the largest consignees, computed at the chapter's grain from shipments: indices of parts can't be averaged."""
    top = F.broadcast(_top(consignees, top_n))
    rows = fact.withColumn("hs_2", F.left("hs_6", F.lit(2))).filter(F.col("hs_2").isin(*CHAPTERS)).join(top, "consignee_key")
    return hhi(rows, ["consignee_name", "hs_2"], ["supplier_key"], name="supplier_hhi").drop("top_share")


def concentration_heatmap(fact: DataFrame, consignees: DataFrame, top_n: int = 30) -> DataFrame:
    return pivot_matrix(concentration_cells(fact, consignees, top_n), "consignee_name", "hs_2", "supplier_hhi", sorted(CHAPTERS))


def supplier_breakdown_for_cell(mart: DataFrame, codes: DataFrame, consignees: DataFrame, consignee_name: str, hs_2: str) -> DataFrame:
    own = consignees.filter(F.col("consignee_name") == F.lit(consignee_name)).select("consignee_key")
    rows = mart.filter(F.left("hs_6", F.lit(2)) == F.lit(hs_2)).join(own, "consignee_key").join(codes.select("hs_6", "hs_6_description"), "hs_6")
    return rows.select("hs_6", "hs_6_description", F.col("total_shipment_count").alias("shipment_count"), "supplier_count", F.round("supplier_hhi", 3).alias("supplier_hhi_hs6"), "is_single_source").orderBy(F.desc("shipment_count"), "hs_6")


def ticker_for_consignee(tickers: DataFrame, consignees: DataFrame, consignee_name: str) -> str | None:
    """Fetches the ticker of an exact match; weaker matches aren't shown."""
    own = consignees.filter(F.col("consignee_name") == F.lit(consignee_name)).select(F.col("consignee_key").alias("matched_consignee_key"))
    row = tickers.filter(F.col("match_confidence") == "exact").join(own, "matched_consignee_key").orderBy("ticker").select("ticker").first()
    return row[0] if row else None


def shipment_summary(fact: DataFrame, mart: DataFrame) -> DataFrame:
    """One row of totals."""
    a = fact.agg(F.count("*").alias("total_shipments"), F.countDistinct("consignee_key").alias("unique_consignees"), F.countDistinct("supplier_key").alias("unique_suppliers"), F.sum("estimated_landed_cost_usd").alias("total_landed_cost"))
    return a.crossJoin(mart.agg(F.count_if(F.col("is_single_source")).alias("single_source_pairs")))


def origin_country_breakdown(fact: DataFrame) -> DataFrame:
    return fact.groupBy("origin_country_code").agg(F.count("*").alias("shipment_count")).orderBy(F.desc("shipment_count"), "origin_country_code")


def hs_chapter_breakdown(fact: DataFrame) -> DataFrame:
    rows = fact.withColumn("hs_2", F.left("hs_6", F.lit(2))).filter(F.col("hs_2").isin(*CHAPTERS))
    return rows.groupBy("hs_2").agg(F.count("*").alias("shipment_count")).orderBy(F.desc("shipment_count"), "hs_2")


def scenario_examples(mart: DataFrame, limit: int = 20) -> DataFrame:
    return mart.orderBy(F.desc("delta_usd"), "consignee_key", "scenario_name", "hs_chapter", "origin_country").limit(limit)


def consignee_options(consignees: DataFrame, limit: int = 50) -> DataFrame:
    return consignees.orderBy(F.col("total_shipments").desc_nulls_last(), "consignee_key").limit(limit).select("consignee_key", "consignee_name")


def agent_trace_stats(traces: DataFrame) -> DataFrame:
    """One row; zeros where there are no traces."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = traces.agg(
        F.count("*").alias("total_queries"), zero(F.expr("percentile(total_latency_ms, 0.5)")).alias("p50_latency_ms"), zero(F.expr("percentile(total_latency_ms, 0.95)")).alias("p95_latency_ms"),
        zero(F.avg("cost_credits_estimate")).alias("avg_cost_credits_estimate"),
    )
    return out.withColumn("avg_cost_usd_estimate", F.col("avg_cost_credits_estimate") * USD_PER_CREDIT)


def recent_traces(traces: DataFrame, limit: int = 20) -> DataFrame:
    return traces.orderBy(F.desc("timestamp"), "trace_id").limit(limit).select("timestamp", "question", "total_latency_ms", "cost_credits_estimate", "tool_calls")


def latency_distribution(traces: DataFrame) -> DataFrame:
    return traces.select("total_latency_ms")


def _calls(tool_calls: Column) -> Column:
    return F.from_json(tool_calls, "array<struct<tool_name: string>>")


def tool_usage_breakdown(traces: DataFrame) -> DataFrame:
    calls = traces.select(F.explode(_calls(F.col("tool_calls"))).alias("c"))
    return calls.groupBy(F.col("c.tool_name").alias("tool_name")).agg(F.count("*").alias("n_calls")).orderBy(F.desc("n_calls"), "tool_name")


def trace_view(traces: DataFrame) -> DataFrame:
    """Recent traces as the panel shows them: seconds, and each trace's set of tools."""
    tools = F.array_join(F.array_sort(F.array_distinct(F.transform(_calls(F.col("tool_calls")), lambda c: c["tool_name"]))), ", ")
    return traces.withColumn("latency_s", F.round(F.col("total_latency_ms") / 1000.0, 1)).withColumn("tools", tools)


def scenario_totals(rows: DataFrame) -> DataFrame:
    """Totals before and after, and the change in percent."""
    t = rows.agg(F.sum("baseline_landed_cost_usd").alias("baseline"), F.sum("scenario_landed_cost_usd").alias("scenario"), F.sum("delta_usd").alias("delta"))
    return t.withColumn("delta_pct", F.coalesce(F.col("delta") / F.nullif(F.col("baseline"), F.lit(0.0)) * 100.0, F.lit(0.0)))


def run_scenario_simulation(fact: DataFrame, consignee_key: str, additional_rate_pp: float, hs_chapters: list[str], origin_countries: list[str], scenario_name: str = "custom") -> DataFrame:
    """A scenario as a form gives it; empty lists mean all."""
    return simulate_tariff_scenario(fact, consignee_key, Scenario(scenario_name, additional_rate_pp, tuple(hs_chapters), tuple(origin_countries)))


def run_agent_query(agent: Agent, question: str, traces: str | None = None) -> dict:
    """The agent's answer, its calls and token counts; with ``traces``, logged there. A failing log doesn't fail the answer."""
    response = agent.run(question)
    if traces:
        try:
            log_trace(agent.tables["fact_shipments"].sparkSession, traces, question, response, response["latency_ms"])
        except Exception as e:  # logging is best effort
            response["log_error"] = str(e)[:200]
    return response


def hhi_band(value: Column) -> Column:
    """low below .15, moderate below .25, high from there."""
    return F.when(value < 0.15, "low").when(value < 0.25, "moderate").when(value.isNotNull(), "high")


def chapter_label(chapter: Column) -> Column:
    out = chapter
    for k, v in CHAPTER_NAMES.items():
        out = F.when(chapter == k, F.lit(f"{k} {v}")).otherwise(out)
    return out


def excerpt(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
