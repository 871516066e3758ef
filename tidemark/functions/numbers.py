"""Columns for decay, rounding, scores and bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Yearly loss of a cohort, share of a stock replaced in a year, and the cap on yearly units.
DECAY, REPLACED, UNITS_CAP = 0.0556, 0.021, 3_000_000


def decay_from_sale(units: Column, age: Column) -> Column:
    """Survivors at an age; nothing before the sale."""
    return F.when(age < 0, F.lit(0.0)).otherwise(units * F.pow(F.lit(1 - DECAY), age))


def decay_after_first_year(units: Column, age: Column) -> Column:
    """Survivors at an age when the first year costs none."""
    return F.when(age <= 1, units.cast("double")).otherwise(units * F.pow(F.lit(1 - DECAY), age - 1))


def percentile_score(value: Column, *by: Column) -> Column:
    """20 times the average-tie rank over the values that are not null, rounded half to even; null stays null."""
    filled = value.isNotNull()
    groups = [*by, filled]
    rank = F.rank().over(Window.partitionBy(*groups).orderBy(value)) + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / 2.0
    return F.when(filled, F.rint(F.least(F.greatest(rank / F.count("*").over(Window.partitionBy(*groups)) * 20, F.lit(0.0)), F.lit(20.0))))


def sum_skipping_nulls(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))


def tier(score: Column) -> Column:
    return F.when(score >= 80, "Top priority").when(score >= 60, "High").when(score >= 40, "Medium").otherwise("Low")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def interval_distance(year: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - year, year - end, F.lit(0))


def world_bounds(local: Column, low_share: Column, high_share: Column) -> tuple[Column, Column]:
    """What total units a local figure allows at these shares, at least the figure itself and at most the cap."""
    low, high = F.ceil(local / F.greatest(high_share, F.lit(1e-6))), F.floor(local / F.greatest(low_share, F.lit(1e-6)))
    return F.least(F.greatest(low, local), F.lit(UNITS_CAP)).cast("long"), F.least(F.greatest(high, local), F.lit(UNITS_CAP)).cast("long")
