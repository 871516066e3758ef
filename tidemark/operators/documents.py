"""Documents in JSON: rows that parse and rows that do not, typed constraints, and the summary of an estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_generation

#: A model's cached document, and one of the merged generations.
CACHE = "struct<model:string,lang:string,windows:array<struct<label:string,start:string,end:string>>>"
REGION = "struct<exact:map<string,bigint>,range:map<string,struct<lo:bigint,hi:bigint>>>"
CONSTRAINTS = f"struct<europe:{REGION},world:{REGION},zero_years:array<int>>"
OPEN = 9999
#: The row of a summary: name, path in the estimate's document, in order (fixed values).
SUMMARY = {
    "Model": "$.data.model", "Generation_Input_or_Detected": "$.seed.generation", "Generation_Window_Start": "$.seed.generation_window.start",
    "Generation_Window_End": "$.seed.generation_window.end", "Generation_Window_Basis": "$.seed.generation_window_basis", "Generation_Alias_Used": "$.seed.generation_alias_used",
    "Generation_Context_From_Model": "$.data.generation_or_trim_context", "Start_Year": "$.data.start_year", "End_Year": "$.data.end_year", "Confidence": "$.data.confidence",
    "Plausibility_Flag": "$.diag.plausibility.flag", "Plausibility_Reason": "$.diag.plausibility.reason", "Seed_Source_Note": "$.diag.plausibility.source_note",
    "Catalogue_Supported": "$.diag.supported_flag", "Catalogue_Match_Type": "$.diag.match_type", "Catalogue_Matched_Row": "$.diag.matched_row",
    "Parent_Model_Key": "$.seed.variant_derivation_note.parent_model_key", "Variant_Derivation_Mode": "$.seed.variant_derivation_note.mode",
    "Variant_EU_Prior_LMH": "$.seed.variant_derivation_note.eu_prior_low_mid_high", "Variant_World_Prior_LMH": "$.seed.variant_derivation_note.world_prior_low_mid_high",
    "Variant_Reasons": "$.seed.variant_derivation_note.reasons",
}


def summary(document: Column) -> list[Column]:
    """The columns of an estimate's summary row, from its document in JSON; an absent reason or note is empty, an absent flag false."""
    read = F.try_parse_json(document)  # one expression for all columns, so a document is parsed once
    said = {name: F.try_variant_get(read, path, "string") for name, path in SUMMARY.items()}
    said["Plausibility_Flag"] = F.coalesce(said["Plausibility_Flag"].try_cast("boolean"), F.lit(False))
    for name in ("Plausibility_Reason", "Seed_Source_Note"):
        said[name] = F.coalesce(said[name], F.lit(""))
    said["Variant_Reasons"] = F.coalesce(F.array_join(F.from_json(said["Variant_Reasons"], "array<string>"), ", "), F.lit(""))
    for name in ("Generation_Window_Start", "Generation_Window_End", "Start_Year", "End_Year"):
        said[name] = said[name].try_cast("bigint")
    return [v.alias(k) for k, v in said.items()]


def constraints_of(document: Column) -> Column:
    """The typed constraints of a document, maps keyed by years as numbers; null where it is none.

    Keys of JSON are text, so they are read as such; one that is no year is left out.
    """
    read = F.from_json(document, CONSTRAINTS)

    def by_year(values: Column) -> Column:
        years = F.map_filter(values, lambda k, _: k.try_cast("int").isNotNull())
        return F.transform_keys(years, lambda k, _: k.try_cast("int"))

    region = lambda r: F.when(read[r].isNotNull(), F.struct(by_year(read[r]["exact"]).alias("exact"), by_year(read[r]["range"]).alias("range"))).alias(r)
    return F.when(read.isNotNull(), F.struct(region("europe"), region("world"), read["zero_years"].alias("zero_years")))


def first_entry(values: Column) -> Column:
    """struct<key, value>: a map's entry of the least key, whatever order the document has; null of an empty map."""
    return F.get(F.array_sort(F.map_entries(values)), F.lit(0))


def range_text(values: Column) -> Column:
    """`year: lo-hi` of a map's first range."""
    x = first_entry(values)
    return F.when(x.isNotNull(), F.concat(x["key"].cast("string"), F.lit(": "), x["value"]["lo"].cast("string"), F.lit("-"), x["value"]["hi"].cast("string")))


def generations(windows: Column) -> Column:
    """array<struct<name, start_year, end_year>> by start, then end (open ends last), each once; windows without years are left out."""
    year = lambda w, name: w[name].try_cast("int")
    held = F.filter(windows, lambda w: year(w, "start").isNotNull() & year(w, "end").isNotNull())
    rows = F.transform(held, lambda w: F.struct(year(w, "start").alias("start_year"), year(w, "end").alias("order"), short_generation(F.coalesce(w["label"], F.lit("GEN"))).alias("name")))
    return F.transform(F.array_sort(F.array_distinct(rows)), lambda g: F.struct(g["name"].alias("name"), g["start_year"].alias("start_year"), F.nullif(g["order"], F.lit(OPEN)).alias("end_year")))


def build(documents: DataFrame) -> DataFrame:
    """key, problem, model, generations: every document once, with what is wrong with it, or its model's generations.

    documents: key, body.  One pass; a document that does not parse, names no model, has no windows or none with years is a row
    with a problem, and none is lost.  Of several good documents of one model the last key counts, by `last_built`.
    """
    rows = documents.select("key", "body", F.from_json("body", CACHE).alias("d"), F.try_parse_json("body").isNotNull().alias("parses"))
    rows = rows.withColumn("generations", generations(F.col("d.windows")))
    named = F.coalesce("d.model", F.lit(""))
    problem = (
        F.when(F.col("body").isNull(), "no document").when(~F.col("parses"), "no json").when(named == "", "no model")
        .when(F.coalesce(F.size("d.windows"), F.lit(0)) == 0, "no windows").when(F.size("generations") == 0, "empty generations")
    )
    return rows.select("key", problem.alias("problem"), F.nullif(named, F.lit("")).alias("model"), F.when(problem.isNull(), F.col("generations")).alias("generations"))


def write_build(documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """key, model, generations of the good rows and key, problem, model of the others: written by one pass into two parts of one table."""
    found = build(documents)
    found.withColumn("good", F.col("problem").isNull().cast("int")).write.partitionBy("good").parquet(path)
    read = found.sparkSession.read.parquet(path)
    return read.where("good = 1").select("key", "model", "generations"), read.where("good = 0").select("key", "problem", "model")


def last_built(good: DataFrame) -> DataFrame:
    """model, generations of the last document of each model."""
    return good.groupBy("model").agg(F.max_by("generations", "key").alias("generations"))
