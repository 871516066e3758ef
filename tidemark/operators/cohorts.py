"""Stock projections: cohorts that decay, and life cycles that are smoothed year by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import REPLACED, decay_after_first_year, decay_from_sale


def project_stock(sales: DataFrame, years: range) -> DataFrame:
    """model, generation, year, stock: survivors of all sales in each year; sales has model, generation, year, units.

    Sales are summed by sale year before they are spread over the years, so the spread is of cohorts, not of sales.
    """
    cohorts = sales.groupBy("model", "generation", F.col("year").alias("sold")).agg(F.sum("units").alias("units"))
    spread = cohorts.withColumn("year", F.explode(F.sequence(F.lit(years.start), F.lit(years.stop - 1))))
    return spread.groupBy("model", "generation", "year").agg(F.sum(decay_from_sale(F.col("units"), F.col("year") - F.col("sold"))).alias("stock"))


def wide(stock: DataFrame, years: range, value: Column, prefix: str) -> DataFrame:
    """One column for each year, named by prefix; missing years are 0."""
    out = stock.groupBy("model", "generation").pivot("year", list(years)).agg(F.first(value))
    return out.select("model", "generation", *[F.coalesce(F.col(f"`{y}`"), F.lit(0)).alias(f"{prefix}{y}") for y in years])


def triangular_stock(sales: DataFrame) -> DataFrame:
    """model, year, stock, repairs: in each sale year of a model, the survivors of all sales up to it.

    A cohort is spread over its model's later sale years; a model has as many of them as calendar years.
    """
    per = sales.groupBy("model", "year").agg(F.sum("units").alias("units"))
    cohorts = per.select("model", F.col("year").alias("sold"), "units")
    joined = per.select("model", "year").join(cohorts, "model").where(F.col("sold") <= F.col("year"))
    out = joined.groupBy("model", "year").agg(F.sum(decay_after_first_year(F.col("units"), F.col("year") - F.col("sold"))).alias("exact"))
    return out.select("model", "year", F.rint("exact").cast("long").alias("stock"), F.rint(F.col("exact") * REPLACED).cast("long").alias("repairs"))


def smooth_lifecycle(rows: DataFrame, zero_years: Column | None = None) -> DataFrame:
    """model, year, raw, smoothed: each year mixes its raw value with growth on the year before's output.

    Growth by years since the first: +35 %, twice +12 %, twice +5 %, then -8 %; six tenths of that and four of raw.
    rows: model, year, raw; a model's years are few, so its array is small.  zero_years: a flag on (model, year, raw).
    """
    flag = F.lit(False) if zero_years is None else zero_years
    seq = rows.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("year", "raw", flag.alias("zero")))).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        since = F.size(acc)
        growth = F.when(since == 1, 0.35).when(since <= 3, 0.12).when(since <= 5, 0.05).otherwise(-0.08)
        mixed = F.greatest(0.6 * F.rint(last["smoothed"] * (1 + growth)) + 0.4 * x["raw"], F.lit(0.0)).cast("long")
        return F.concat(acc, F.array(F.struct(x["year"].alias("year"), x["raw"].alias("raw"), F.when(x["zero"], F.lit(0)).otherwise(mixed).cast("long").alias("smoothed"))))

    first = F.get("s", F.lit(0))
    start = F.array(F.struct(first["year"].alias("year"), first["raw"].alias("raw"), first["raw"].cast("long").alias("smoothed")))
    out = seq.select("model", F.explode(F.aggregate(F.slice("s", F.lit(2), F.size("s")), start, step)).alias("x"))
    return out.select("model", "x.year", "x.raw", "x.smoothed")
