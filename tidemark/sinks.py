"""Outputs as files: scores, estimates, window caches and the merged generations, written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import safe_slug
from .operators.lookups import merge_upsert
from .operators.publish import table_names

OPEN = 9999


def write_scores(rows: DataFrame, path: str) -> None:
    """JSON lines of model, score in the order of models (range partitioned, so files are in order)."""
    rows.select("model", "score").repartitionByRange("model").sortWithinPartitions("model").write.mode("overwrite").json(path)


def write_estimates(rows: DataFrame, path: str) -> None:
    """CSV of year, world_sales_units, europe_sales_units in the order of years."""
    rows.select("year", "world_sales_units", "europe_sales_units").repartitionByRange("year").sortWithinPartitions("year").write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of Parquet for each named table, as the sheets of a workbook."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name.replace(' ', '_')}")


def write_windows(rows: DataFrame, path: str) -> None:
    """Window caches, a folder for each model's slug: model, windows (label, start, end with 9999 for an open one)."""
    window = F.struct("label", "start", F.coalesce("end", F.lit(OPEN)).alias("end"))
    cache = rows.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("start", "label", window.alias("w")))).alias("x"))
    cache.select(safe_slug(F.col("model")).alias("slug"), "model", F.transform("x", lambda v: v["w"]).alias("windows")).write.mode("overwrite").partitionBy("slug").json(path)


def read_windows(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """model, label, start, end (null: open) of all caches, or of one model's, which prunes to its folder."""
    cache = spark.read.schema("slug string, model string, windows array<struct<label:string,start:int,end:int>>").json(path)
    if model is not None:
        cache = cache.where(F.col("slug") == safe_slug(F.lit(model)))
    return cache.select("model", F.explode("windows").alias("w")).select("model", "w.label", "w.start", F.nullif("w.end", F.lit(OPEN)).alias("end"))


def upsert_generations(old: DataFrame, new: DataFrame, path: str, version: int = 1, today: str | None = None) -> None:
    """Generations by model: new ones replace old ones of the same model; other columns of a model stay.  Beside them the version and the day."""
    merge_upsert(old, new, "model", ["generations"]).repartitionByRange("model").sortWithinPartitions("model").write.mode("overwrite").json(f"{path}/models")
    day = F.current_date() if today is None else F.lit(today)
    old.sparkSession.range(1).select(F.lit(version).alias("version"), F.date_format(day, "yyyy-MM-dd").alias("updated_at")).write.mode("overwrite").json(f"{path}/meta")


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """The merged generations; a folder that is absent or holds no documents gives no rows."""
    schema = "model string, parent_model string, generations array<struct<name:string,start_year:int,end_year:int>>"
    if "models" not in table_names(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/models")
