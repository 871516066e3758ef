"""Opportunity scores, and the union of two regions under a null policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import sum_skipping_nulls, tier

SCORES = ("stock_score", "repl_score", "years_score", "gen_score", "supported_score", "ev_score")


def opportunity_scores(rows: DataFrame) -> DataFrame:
    """rows (model, generation, future_stock, future_repl, years_in_list, supported, ev) with scores, total and tier.

    A model and generation stand in one row.  The number of a model's generations is one of the ranked values.
    """
    count = F.size(F.collect_set("generation").over(Window.partitionBy("model")))
    rows = rows.withColumn("gen_count", F.when(F.col("model").isNull(), 1).otherwise(count))
    rows = percentile_scores(rows, {"stock_score": "future_stock", "repl_score": "future_repl", "years_score": "years_in_list", "gen_score": "gen_count"}, ("model", "generation"))
    rows = rows.withColumn("supported_score", F.when(F.col("supported"), 20.0).otherwise(10.0)).withColumn("ev_score", F.when(F.col("ev"), 10.0).otherwise(20.0))
    rows = rows.withColumn("score", sum_skipping_nulls(*map(F.col, SCORES)))
    return rows.withColumn("recommendation", tier(F.col("score")))


def log_bucket(value: Column) -> Column:
    """A number that never falls as value rises, and takes some thousands of values at most."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * 64)).cast("int")


def percentile_scores(rows: DataFrame, scores: dict[str, str], key: tuple[str, ...]) -> DataFrame:
    """rows with each score: 20 times the average-tie rank of its value over the values that are not null; null stays null.

    All values are ranked at once, in long form.  Only the counts of log_bucket meet in one ordered window for each score; ranks
    are taken bucket by bucket over distinct values.  key names a row.
    """
    value = F.array(*[F.struct(F.lit(name).alias("name"), F.col(v).cast("double").alias("value")) for name, v in scores.items()])
    long = rows.withColumn("_m", F.explode(value)).withColumn("_bucket", log_bucket(F.col("_m.value")))
    per = long.where("_m.value is not null").groupBy(F.col("_m.name").alias("_name"), "_bucket", F.col("_m.value").alias("_value")).agg(F.count("*").alias("_n"))
    sums = per.groupBy("_name", "_bucket").agg(F.sum("_n").alias("_all"))
    upto = F.sum("_all").over(Window.partitionBy("_name").orderBy("_bucket"))
    before = sums.select("_name", "_bucket", (upto - F.col("_all")).alias("_before"), F.sum("_all").over(Window.partitionBy("_name")).alias("_total"))
    within = F.sum("_n").over(Window.partitionBy("_name", "_bucket").orderBy("_value")) - F.col("_n")
    rank = F.col("_before") + within + (F.col("_n") + 1) / 2
    ranks = per.join(before, ["_name", "_bucket"]).select("_name", "_value", F.rint(F.least(F.greatest(rank / F.col("_total") * 20, F.lit(0.0)), F.lit(20.0))).alias("_score"))
    found = long.join(ranks, (F.col("_m.name") == F.col("_name")) & (F.col("_m.value") == F.col("_value")), "left")
    rest = [F.first(c).alias(c) for c in rows.columns if c not in key]
    return found.groupBy(*key).agg(*rest, *[F.max(F.when(F.col("_m.name") == name, F.col("_score"))).alias(name) for name in scores])


def combine_regions(world: DataFrame, local: DataFrame) -> DataFrame:
    """Full outer join on model and generation: figures of the world, else local, else 0.

    years_in_list: the larger of both; the world's alone if there is no local one; null for a local row alone.
    """
    keys = ["model", "generation"]
    w = world.select(*keys, *[F.col(c).alias(f"{c}_w") for c in ("future_stock", "future_repl", "years_in_list")])
    e = local.select(*keys, *[F.col(c).alias(f"{c}_e") for c in ("future_stock", "future_repl", "years_in_list")])
    return preferred(w.join(e, keys, "full_outer"))


def preferred(both: DataFrame) -> DataFrame:
    """The same of rows that hold the figures of both regions, those of the world ending in _w and local ones in _e."""
    years = F.when(F.col("years_in_list_w").isNotNull(), F.greatest("years_in_list_w", F.coalesce("years_in_list_e", F.lit(0))))
    return both.select("model", "generation", *[F.coalesce(f"{c}_w", f"{c}_e", F.lit(0)).alias(c) for c in ("future_stock", "future_repl")], years.alias("years_in_list"))


def percentile_by_buckets(rows: DataFrame, value: str, bucket: Column) -> DataFrame:
    """rows with `pct`, the average-tie rank of value over the count of values; null values stay null.

    `bucket` must never fall as value rises.  Only its counts, one row a bucket, meet in one ordered window; the ranks
    within a bucket are taken bucket by bucket, so no task sees all rows.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(bucket.alias("_bucket"), value).agg(F.count("*").alias("_n"))
    sums = per.groupBy("_bucket").agg(F.sum("_n").alias("_all"))
    order = Window.orderBy("_bucket")
    before = sums.select("_bucket", (F.sum("_all").over(order) - F.col("_all")).alias("_before"), F.sum("_all").over(Window.partitionBy()).alias("_total"))
    within = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(value)) - F.col("_n")
    ranks = per.join(before, "_bucket").select(value, ((F.col("_before") + within + (F.col("_n") + 1) / 2) / F.col("_total")).alias("pct"))
    return rows.join(ranks, value, "left")
