"""Yearly sales lists and the support catalogue, read from text files."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import catalogue_tokens, normalize_generation_label, normalize_name, title_case_tidy

REGIONS = ("EU", "World")
SALES = "file string, record int, region string, year int, model string, generation string, units long, estimated boolean"


class ListFile(NamedTuple):
    path: str
    region: str
    year: int


def list_files(spark: SparkSession, folder: str, regions: tuple[str, ...] = REGIONS, years: range | None = None) -> list[ListFile]:
    """The lists of a folder in the order of their paths, by their names alone; no file is opened.

    `Top100_2015.txt` is Europe's list of a year, `Top100_World_2015.txt` the world's; the year is the first group of four
    digits, and a name without one is no list.  A folder holds a file for each region and year, so they are few.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/Top100_*.txt")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    out = []
    for status in found or []:
        path, name = status.getPath().toString(), status.getPath().getName()
        year = re.search("[0-9]{4}", name.removeprefix("Top100_").removesuffix(".txt"))
        region = "World" if "_World_" in name else "EU"
        if year and region in regions and (years is None or int(year[0]) in years):
            out.append(ListFile(path, region, int(year[0])))
    return sorted(out)


def read_lists(spark: SparkSession, folder: str, regions: tuple[str, ...] = REGIONS, years: range | None = None) -> DataFrame:
    """file, record (place in its file), region, year, model, generation, units, estimated of every record.

    Only the files of the regions and years asked for are listed for reading.  A place is the file's path and the record's
    number in it, so it holds across files, runs and lost executors.  Units fall back to the projected ones where a record has
    no such field (a field that is null stays null), a name to `name`; a file that is no JSON array gives no rows.
    """
    files = list_files(spark, folder, regions, years)
    if not files:
        return spark.createDataFrame([], SALES)
    whole = spark.read.text([f.path for f in files], wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    stem = F.regexp_extract("file", r"([^/]*)\.txt$", 1)
    rows = whole.select(
        "file", F.when(F.contains(stem, F.lit("_World_")), "World").otherwise("EU").alias("region"), F.regexp_extract(F.replace(stem, F.lit("Top100_"), F.lit("")), "([0-9]{4})", 1).cast("int").alias("year"),
        F.posexplode(F.from_json("value", "array<variant>")).alias("record", "r"),
    ).where(F.startswith(F.schema_of_variant("r"), F.lit("OBJECT")))
    return rows.select("file", "record", "region", "year", *_fields(F.col("r")))


def _fields(r: Column) -> list[Column]:
    said = lambda name: F.nullif(F.try_variant_get(r, f"$.{name}", "string"), F.lit(""))
    # a field that is null is a null variant, one that is absent is no variant at all
    units = F.coalesce(F.try_variant_get(r, "$.units_sold", "variant"), F.try_variant_get(r, "$.projected_units_2025", "variant"))
    whole = F.when(F.schema_of_variant(units) == "BIGINT", F.try_variant_get(units, "$", "bigint"))
    estimated = F.coalesce(F.try_variant_get(r, "$.estimated", "boolean"), F.lit(False))
    return [F.coalesce(said("model"), said("name")).alias("model"), said("generation").alias("generation"), whole.alias("units"), estimated.alias("estimated")]


def keyed_history(rows: DataFrame, position: tuple[str, ...] = ("file", "record")) -> DataFrame:
    """region, key, year, model, generation, units, estimated: the last record of each key and year by its position.

    Records without a model or without whole units count for nothing, so an earlier one with units stays.  The last record is
    found by an aggregate that combines before the shuffle, so a key with many records costs one row a task.
    """
    named = rows.where("model is not null and units is not null").withColumn("key", normalize_name(F.col("model")))
    last = F.max_by(F.struct("model", "generation", "units", "estimated"), F.struct(*position))
    return named.groupBy("region", "key", "year").agg(last.alias("x")).select("region", "key", "year", "x.*")


def sales_rows(rows: DataFrame) -> DataFrame:
    """region, model, generation, year, units of every record, tidied; no units count as 0, and no record is dropped."""
    generation = normalize_generation_label(F.col("generation"))
    return rows.where("model is not null").select("region", title_case_tidy(F.col("model")).alias("model"), generation.alias("generation"), "year", F.coalesce("units", F.lit(0)).alias("units"))


def require_sales(rows: DataFrame) -> DataFrame:
    """The rows, if any region has some; a region without files is an empty part of them."""
    if rows.limit(1).isEmpty():
        raise ValueError("no sales list was found, of neither region")
    return rows


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """key, from_year, code of a catalogue: a CSV table of these columns, or a relaxed map text, by the path's end.

    The text may have unquoted years, trailing commas, and keys that come twice; of a key's equal years the last one counts.
    """
    if path.lower().endswith(".csv"):
        return spark.read.schema("key string, from_year int, code string").option("header", True).csv(path).withColumn("key", normalize_name(F.col("key")))
    if not path.lower().endswith((".json", ".txt")):
        raise ValueError(f"a catalogue is CSV, JSON or text: {path}")
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.posexplode(F.regexp_extract_all("value", F.lit(r'("[^"]+"\s*:\s*\{[^}]*\})'), F.lit(1))).alias("i", "entry"))
    pairs = F.regexp_extract_all("entry", F.lit(r'([0-9]{4}"?\s*:\s*"[^"]+")'), F.lit(1))
    rows = entries.select("i", normalize_name(F.regexp_extract("entry", r'^"([^"]+)"', 1)).alias("key"), F.posexplode(pairs).alias("j", "pair"))
    rows = rows.select("i", "j", "key", F.regexp_extract("pair", "^([0-9]{4})", 1).cast("int").alias("from_year"), F.regexp_extract("pair", '"([^"]+)"$', 1).alias("code"))
    return rows.groupBy("key", "from_year").agg(F.max_by("code", F.struct("i", "j")).alias("code"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """token: the distinct names of a catalogue that is read line by line."""
    return spark.read.text(path).select(F.explode(catalogue_tokens(F.col("value"))).alias("token")).distinct()
