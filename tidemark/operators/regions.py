"""A region's outputs as one job: yearly stocks and replacements in wide form, years in the list, and the picked year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import REPLACED, decay_from_sale
from .scoring import combine_regions, opportunity_scores

#: Columns of an opportunity sheet, in order (fixed values); those that a region lacks are null.
OPPORTUNITY = {
    "model": "string", "generation": "string", "future_stock": "bigint", "future_repl": "double", "years_in_list": "bigint", "stock_score": "double", "repl_score": "double",
    "years_score": "double", "supported_score": "double", "ev_score": "double", "gen_score": "double", "score": "double", "recommendation": "string",
}


def wide_measures(sales: DataFrame, years: range) -> DataFrame:
    """model, generation, years_in_list, then for each year `y_fleet` (stock rounded up) and `y_repl` (replacements, rounded half to even).

    sales: model, generation, year, units; a row counts as one appearance.  Each year's stock is one sum over the sale years, so
    both measures come from one aggregate: no sale is spread over the years, and no two wide tables are joined.
    """
    stock = {y: F.sum(decay_from_sale(F.col("units"), F.lit(y) - F.col("year"))) for y in years}
    sums = sales.groupBy("model", "generation").agg(F.count("*").alias("years_in_list"), *[F.round(v, 6).alias(f"_{y}") for y, v in stock.items()])
    fleet = lambda y: F.ceil(f"_{y}").alias(f"{y}_fleet")
    repl = lambda y: F.rint(F.round(F.col(f"_{y}") * REPLACED, 6)).alias(f"{y}_repl")
    return sums.select("model", "generation", "years_in_list", *[m(y) for m in (fleet, repl) for y in years])


def in_order(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with these columns in this order; one that is missing is null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def opportunities(wide: DataFrame, picked: int) -> DataFrame:
    """model, generation, future_stock, future_repl, years_in_list of the picked year."""
    return wide.select("model", "generation", F.col(f"`{picked}_fleet`").alias("future_stock"), F.col(f"`{picked}_repl`").alias("future_repl"), "years_in_list")


def workbook(sales: DataFrame, years: range, picked: int, supported: Column, ev: Column) -> dict[str, DataFrame]:
    """The tables of the workbook by name; sales: region ('EU' or 'World'), model, generation, year, units.

    A list of each sale year and region is a part of `Lists`, which is written by these two columns, so that their number may grow.
    """
    out = {"Lists": sales.select("region", "year", "model", "generation", "units")}
    found = {}
    for region in ("EU", "World"):
        wide = wide_measures(sales.where(F.col("region") == region), years)
        out[f"{region} Fleet"] = wide.select("model", "generation", *[F.col(f"`{y}_fleet`").alias(str(y)) for y in years])
        out[f"{region} Replacements"] = wide.select("model", "generation", *[F.col(f"`{y}_repl`").alias(str(y)) for y in years])
        found[region] = opportunities(wide, picked)
    found["Combined"] = combine_regions(found["World"], found["EU"])
    for name, rows in found.items():
        scored = opportunity_scores(rows.withColumn("supported", supported).withColumn("ev", ev))
        out[f"{name} Opportunities"] = in_order(scored, OPPORTUNITY)
    return out
