"""What is shown and written of an estimate: its sheets, names of files, and tables and lines as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import REPLACED, decay_after_first_year
from ..functions.text import normalize_generation_key
from .estimates import LAST_YEAR

FIRST_YEAR = 1990


def fleet_of_both(rows: DataFrame) -> DataFrame:
    """model, year, world_fleet, europe_fleet, world_repairs, europe_repairs; rows: model, year, world, europe.

    In each year of a model the survivors of all its sales up to it, rounded half to even, as are the repairs of the exact stock.
    A model has as many rows as calendar years, so its years are one small array, gone through once for both series.
    """
    series = rows.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("year", "world", "europe"))).alias("s"))

    def stock(x: Column, i: Column, name: str) -> Column:
        return F.aggregate(F.slice("s", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + decay_after_first_year(y[name], x["year"] - y["year"])).alias(name)

    years = F.transform("s", lambda x, i: F.struct(x["year"].alias("year"), stock(x, i, "world"), stock(x, i, "europe")))
    out = series.select("model", F.explode(years).alias("x")).select("model", "x.*")
    whole = lambda c: F.rint(c).cast("long")
    fleets = [whole(F.col(c)).alias(f"{c}_fleet") for c in ("world", "europe")]
    return out.select("model", "year", *fleets, *[whole(F.col(c) * REPLACED).alias(f"{c}_repairs") for c in ("world", "europe")])


def estimate_sheets(rows: DataFrame, windows: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The sheets Estimates and Fleet_Repairs; rows: model, year, world, europe, rationale; windows: model, first, final; found: model, supported, match_type.

    An estimate has its year's fleet beside it, whether its generation is made in that year (false where a bound is missing), and the
    catalogue's answer.  The summary and the documents of a model are rows of `documents.summary`.
    """
    fleet = fleet_of_both(rows)
    active = F.coalesce(F.col("year").between(F.col("first"), F.col("final")), F.lit(False))
    sheet = rows.select("model", "year", F.col("world").alias("world_sales"), F.col("europe").alias("europe_sales"), "rationale").join(fleet, ["model", "year"], "left").join(windows, "model", "left").join(found, "model", "left")
    columns = ["model", "year", "world_sales", "europe_sales", "rationale", "world_fleet", "europe_fleet", "world_repairs", "europe_repairs"]
    return {"Estimates": sheet.select(*columns, active.alias("gen_active"), "supported", "match_type"), "Fleet_Repairs": fleet}


def base_name(model: Column, generation: Column, launch: Column, tool: str, at: Column) -> Column:
    """The name of an estimate's files: model, normalised generation, first year, what made it, and when."""
    under = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    label = F.when(F.coalesce(generation, F.lit("")) == "", "GEN").otherwise(generation)
    return F.concat_ws("_", F.lit("sales_estimates"), under(model), under(normalize_generation_key(label)), launch.cast("string"), F.lit(tool), F.date_format(at, "yyyyMMdd-HHmmss"))


def generation_line(model: Column, generations: Column) -> Column:
    """`model: generation 1: 2004-2011, generation 2: 2012-present` of an array of struct<start_year, end_year> in order."""
    one = lambda g, i: F.concat(F.lit("generation "), (i + 1).cast("string"), F.lit(": "), g["start_year"].cast("string"), F.lit("-"), F.coalesce(g["end_year"].cast("string"), F.lit("present")))
    return F.concat(model, F.lit(": "), F.array_join(F.transform(generations, one), ", "))


def preview(rows: DataFrame, columns: dict[str, str], order: list[Column], n: int = 10) -> DataFrame:
    """place, line: the first n rows as a text table with bars, numbers to the right; columns: a column by its heading.

    A column is as wide as its widest cell, or its heading and two more.  Only n rows are laid out.
    """
    first = rows.orderBy(*order).limit(n)
    cells = first.select(F.array(*[F.col(c).cast("string") for c in columns.values()]).alias("cells"), F.struct(*[F.col(c) for c in columns.values()]).alias("row"))
    held = cells.agg(*[F.greatest(F.max(F.length(F.col("cells")[i])), F.lit(len(h) + 2)).alias(f"w{i}") for i, h in enumerate(columns)], F.collect_list("cells").alias("all"))
    wide = [F.coalesce(F.col(f"w{i}"), F.lit(len(h) + 2)) for i, h in enumerate(columns)]
    line = lambda cell: F.concat(F.lit("| "), F.array_join(F.array(*[F.lpad(cell(i), wide[i], " ") for i in range(len(columns))]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array(*[F.repeat(F.lit("-"), w + 2) for w in wide]), "|"), F.lit("|"))
    names = list(columns)
    lines = F.concat(F.array(line(lambda i: F.lit(names[i])), rule), F.transform("all", lambda r: line(lambda i: r[i])))
    return held.select(F.posexplode(lines).alias("place", "line"))


def table_names(spark: SparkSession, path: str) -> list[str]:
    """The tables written into a folder; none of a folder that is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()) if system.exists(place) else []


def year_tables(spark: SparkSession, path: str, region: str) -> list[str]:
    """The yearly lists of a region among them, in order."""
    return [n for n in table_names(spark, path) if re.fullmatch(rf"20[0-9]{{2}}_{re.escape(region)}", n)]


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the folder by its name, blanks in it as underscores; none where there is no such table."""
    name = name.replace(" ", "_")
    return spark.read.parquet(f"{path}/{name}") if name in table_names(spark, path) else None


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The file or folder of a pattern that was changed last, by the listing alone; ties go to the greater path; none if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return max(((s.getModificationTime(), s.getPath().toString()) for s in found or []), default=(0, None))[1]


def year_span(text: str) -> range:
    """`2015-2025`, both included, or a single year."""
    first, _, last = text.strip().partition("-")
    return range(int(first), int(last or first) + 1)


def request(model: str, generation: str, year: str | int) -> tuple[str, str, int]:
    """A model, a generation (may be empty) and a year that can be asked for, trimmed."""
    at = int(str(year).strip())
    if not FIRST_YEAR <= at <= LAST_YEAR:
        raise ValueError(f"the year must be between {FIRST_YEAR} and {LAST_YEAR}")
    return model.strip(), generation.strip(), at
