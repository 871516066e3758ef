"""Whether a catalogue supports a model's generation in a year, with how it was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_generation_key, normalize_name

#: Catalogue keys up to which the catalogue is sent to every task (some hundred bytes each); a larger one is joined by a shuffle.
SENT_KEYS = 100_000


def support(asked: DataFrame, catalogue: DataFrame, sent_keys: int = SENT_KEYS) -> DataFrame:
    """asked (key, generation, year) with supported, match_type, code, from_year.

    catalogue: key, from_year, code.  The code in force is that of the latest year not after the one asked for.  Outcomes:
    its label is the generation asked for, it is another, the model's codes all begin later, the model is absent.

    A key has as many codes as calendar years at most, so they are one sorted array, in which the year's code and the label's
    equality are looked up in one step.  The array of a key is joined to what is asked: sent to every task where keys are few by
    their count, else by a shuffle whose hot keys adaptive execution splits.
    """
    known = catalogue.groupBy("key", "from_year").agg(F.max("code").alias("code")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from_year", "code"))).alias("codes"))
    if known.limit(sent_keys + 1).count() <= sent_keys:
        known = F.broadcast(known)
    rows = asked.join(known, "key", "left").withColumn("active", F.try_element_at(F.filter("codes", lambda c: c["from_year"] <= F.col("year")), F.lit(-1)))
    same = normalize_generation_key(F.col("active.code")) == normalize_generation_key(F.col("generation"))
    match = F.when(F.col("codes").isNull(), "no_model_match").when(F.col("active").isNull(), "model_present_no_year_coverage").when(same, "by_year_exact_gen").otherwise("by_year_diff_gen_label")
    return rows.select(*asked.columns, F.col("active").isNotNull().alias("supported"), match.alias("match_type"), F.col("active.code").alias("code"), F.col("active.from_year").alias("from_year"))


def support_by_table(asked: DataFrame, table: DataFrame | None) -> DataFrame:
    """asked (key) with supported ('true', 'false' or 'unknown') and match_type by a table of models without years, or none."""
    fixed = lambda flag, match: asked.select("*", F.lit(flag).alias("supported"), F.lit(match).alias("match_type"))
    if table is None or table.limit(1).isEmpty():
        return fixed("unknown", "no_catalog")
    named = [c for c in table.columns if c.lower() == "model"]
    if not named:
        return fixed("unknown", "no_model_column")
    models = table.select(normalize_name(F.col(named[-1]).cast("string")).alias("key")).distinct().withColumn("_held", F.lit(True))
    rows = asked.join(models, "key", "left")
    return rows.select(*asked.columns, F.when(F.col("_held"), "true").otherwise("false").alias("supported"), F.when(F.col("_held"), "model_present_diff_gen_no_year_map").otherwise("no_model_match").alias("match_type"))
