"""Weights, duties and landed cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KG_PER_POUND = 0.453592


def weight_kg(weight: Column, unit: Column) -> Column:
    """Kilograms; a weight without a unit is taken to be in kilograms."""
    return F.when(F.upper(unit) == "POUNDS", weight.cast("double") * KG_PER_POUND).otherwise(weight.cast("double"))


def effective_duty_pct(general: Column, s232: Column, s301: Column, hit_232: Column, hit_301: Column) -> Column:
    """General duty and, where the country's flag is true, the additional ones; a missing rate or flag adds nothing."""
    zero = F.lit(0.0)
    extra = lambda flag, rate: F.when(flag, F.coalesce(rate, zero)).otherwise(zero)
    return F.coalesce(general, zero) + extra(hit_232, s232) + extra(hit_301, s301)


def landed_cost(value: Column, duty_pct: Column) -> Column:
    """Value with duty; null for a null value."""
    return value.cast("double") * (F.lit(1.0) + duty_pct / 100.0)
