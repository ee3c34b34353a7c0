"""What-if tariffs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Scenario:
    """Percentage points on top of the duty of matching shipments; no chapters or no countries means all."""

    name: str = ""
    additional_rate_pp: float = 0.0
    hs_chapters: tuple[str, ...] = ()
    origin_countries: tuple[str, ...] = ()

    @classmethod
    def of(cls, d: dict) -> Scenario:
        return cls(d.get("scenario_name") or "", float(d.get("additional_rate_pp") or 0.0), tuple(d.get("hs_chapters") or ()), tuple(d.get("origin_countries") or ()))


CANONICAL = (
    Scenario("Vietnam apparel +15pp", 15.0, ("61", "62"), ("VN",)),
    Scenario("Mexico +10pp all chapters", 10.0, (), ("MX",)),
    Scenario("S301 China electronics", 25.0, ("84", "85"), ("CN",)),
    Scenario("S232 EU auto", 25.0, ("87",), tuple("BE DE ES FR GB IT".split())),
    Scenario("S232 doubles globally", 25.0, ("72", "73", "76")),
)


def scenario_frame(spark, scenarios: Sequence[Scenario] = CANONICAL) -> DataFrame:
    rows = [(s.name, s.additional_rate_pp, list(s.hs_chapters), list(s.origin_countries)) for s in scenarios]
    return spark.createDataFrame(rows, "scenario_name string, additional_rate_pp double, hs_chapters array<string>, origin_countries array<string>")


def _matches(values: Column, x: Column) -> Column:
    return (F.size(F.coalesce(values, F.array().cast("array<string>"))) == 0) | F.coalesce(F.array_contains(values, x), F.lit(False))


_RESULT = "hs_chapter origin_country total_shipments baseline_duty_rate_pct scenario_duty_rate_pct baseline_value_usd baseline_landed_cost_usd scenario_landed_cost_usd delta_usd delta_pct".split()


def simulate(groups: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every group under every scenario. Groups: chapter, country, shipments, rate, value and landed cost, and any keys.

    The increment goes on top of the true landed cost. Computing that anew
    from an average rate would show a difference where nothing changes.
    """
    zero = F.lit(0.0)
    x = groups.crossJoin(F.broadcast(scenarios))
    hit = _matches(F.col("hs_chapters"), F.col("hs_chapter")) & _matches(F.col("origin_countries"), F.col("origin_country"))
    x = x.withColumn("inc", F.when(hit, F.coalesce("additional_rate_pp", zero)).otherwise(zero))
    for c in ("baseline_duty_rate_pct", "baseline_value_usd", "baseline_landed_cost_usd"):
        x = x.withColumn(c, F.coalesce(F.col(c).cast("double"), zero))
    x = x.withColumn("scenario_duty_rate_pct", F.col("baseline_duty_rate_pct") + F.col("inc"))
    x = x.withColumn("delta_usd", F.col("baseline_value_usd") * F.col("inc") / 100.0)
    x = x.withColumn("scenario_landed_cost_usd", F.col("baseline_landed_cost_usd") + F.col("delta_usd"))
    x = x.withColumn("delta_pct", F.when(F.col("baseline_landed_cost_usd") != 0, F.col("delta_usd") / F.col("baseline_landed_cost_usd") * 100.0).otherwise(zero))
    return x.drop("inc", "hs_chapters", "origin_countries")


def group_fact(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Valued shipments by chapter and country, and ``keys``."""
    valued = fact.filter(F.col("shipment_value_usd").isNotNull())
    return valued.groupBy(*keys, F.left("hs_6", F.lit(2)).alias("hs_chapter"), F.col("origin_country_code").alias("origin_country")).agg(
        F.count("*").alias("total_shipments"), F.avg("effective_duty_rate_pct").alias("baseline_duty_rate_pct"), F.sum("shipment_value_usd").cast("double").alias("baseline_value_usd"), F.sum("estimated_landed_cost_usd").alias("baseline_landed_cost_usd")
    )


def simulate_tariff_scenario(fact: DataFrame, consignee_key: str, scenario: Scenario | dict) -> DataFrame:
    """One consignee's groups under one scenario; no valued shipments give no rows, with all columns."""
    s = scenario if isinstance(scenario, Scenario) else Scenario.of(scenario)
    own = fact.filter(F.col("consignee_key") == F.lit(consignee_key))
    return simulate(group_fact(own), scenario_frame(fact.sparkSession, [s])).select(*_RESULT)


def _listed(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def simulate_as_json(fact: DataFrame, consignee_key: str, additional_rate_pp: float, hs_chapters: str | None, origin_countries: str | None, scenario_name: str | None) -> str:
    """The same for callers that have texts only: comma lists in, one JSON object with ``scenario_name`` and ``rows`` out."""
    out = simulate_tariff_scenario(fact, consignee_key, Scenario(scenario_name or "", additional_rate_pp, _listed(hs_chapters), _listed(origin_countries)))
    rows = F.coalesce(F.array_sort(F.collect_list(F.struct(*_RESULT))), F.array())
    # One consignee has at most chapters times countries rows.
    return out.agg(F.to_json(F.struct(F.lit(scenario_name).alias("scenario_name"), rows.alias("rows")), {"ignoreNullFields": "false"})).first()[0]


def mart_scenario_examples(fact: DataFrame, consignees: DataFrame, top: int = 20, scenarios: Sequence[Scenario] = CANONICAL) -> DataFrame:
    """The largest consignees under all scenarios, where costs rise: one plan, not a call for each."""
    best = consignees.select("consignee_key", "consignee_name", "total_shipments").orderBy(F.col("total_shipments").desc_nulls_last(), "consignee_key").limit(top).drop("total_shipments")
    groups = group_fact(fact.join(F.broadcast(best), "consignee_key"), ["consignee_key", "consignee_name"])
    out = simulate(groups, scenario_frame(fact.sparkSession, scenarios)).filter(F.col("delta_usd") > 0)
    return out.select("consignee_key", "consignee_name", "scenario_name", *_RESULT)
