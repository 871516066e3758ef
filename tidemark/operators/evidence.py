"""Figures from search results: what is asked, what the answers say, and the best number for each region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import candidate_numbers, normalize_generation_key, normalize_name

# Words of sales and of prices, names of the regions, countries and spans shorter than a year.
SALES_WORDS = ("sales", "sold", "units", "registrations", "deliveries", "volume", "shipments")
PRICE_WORDS, CURRENCIES = ("msrp", "price"), ("€", "$", "£")
REGIONS = {"europe": ("europe", "eu", "efta", "european", "eu27", "eu28", "eu+efta", "eu/efta", "eu+uk"), "world": ("world", "global", "worldwide")}
COUNTRY = r"\b(uk|germany|france|italy|spain|poland|netherlands|sweden|norway)\b"
PART_OF_YEAR = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|q[1-4]|month|monthly)\b"
# What is searched for beside the model and its year, and what is searched for on single sites.
SEARCHES = ("sales europe -price -msrp -€ -$", "registrations europe -price -msrp -€ -$", "global sales -price -msrp -€ -$", "worldwide sales -price -msrp -€ -$")
SITES = (("carsalesbase.com", "sales"), ("acea.auto", "registrations"), ("marklines.com", "sales"))
#: Search results that are read of each answer.
RESULTS = 10


def _any(text: Column, words) -> Column:
    hits = [F.contains(text, F.lit(w)) for w in words]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def looks_like_price(text: Column) -> Column:
    return _any(text, CURRENCIES) | _any(F.lower(text), PRICE_WORDS)


def has_sales_context(text: Column) -> Column:
    return _any(F.lower(text), SALES_WORDS)


def generation_aliases(generation: Column) -> Column:
    """The label itself and, of an mkN label, its other spellings, sorted; none of an empty one."""
    label = F.trim(F.coalesce(generation, F.lit("")))
    n = F.regexp_extract(normalize_generation_key(label), "^mk(.*)$", 1)
    spelled = F.array(label, F.concat(F.lit("mk"), n), F.concat(F.lit("mk "), n), F.concat(F.lit("mark "), n), F.concat(n, F.lit("th generation")))
    return F.when(label == "", F.array().cast("array<string>")).when(F.startswith(normalize_generation_key(label), F.lit("mk")), F.array_sort(F.array_distinct(spelled))).otherwise(F.array(label))


def search_queries(model: Column, generation: Column, year: Column) -> Column:
    """Four searches without prices, of the model and any spelling of its generation, and three of single sites."""
    name = F.concat(F.lit('"'), model, F.lit('"'))
    spelled = F.array_join(F.transform(generation_aliases(generation), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), " OR ")
    full = F.when(spelled == "", name).otherwise(F.concat(name, F.lit(" ("), spelled, F.lit(")")))
    year = year.cast("string")
    wide = [F.concat_ws(" ", full, year, F.lit(words)) for words in SEARCHES]
    return F.array(*wide, *[F.concat_ws(" ", F.lit(f"site:{site}"), name, year, F.lit(word)) for site, word in SITES])


def text_blobs(answer: Column) -> Column:
    """array<struct<source, text, url>> of a search answer in JSON: the texts of its two boxes, then its first results; no prices."""
    blob = lambda source, text, url: F.struct(F.lit(source).alias("source"), text.alias("text"), F.coalesce(url, F.lit("")).alias("url"))
    page = F.get_json_object(answer, "$.search_metadata.google_url")

    def box(name: str) -> Column:
        held = F.map_values(F.from_json(F.get_json_object(answer, f"$.{name}"), "map<string,variant>"))
        texts = F.filter(held, lambda v: F.schema_of_variant(v) == "STRING")
        return F.coalesce(F.transform(texts, lambda v: blob(name, v.cast("string"), page)), none)

    none = F.array().cast("array<struct<source:string,text:string,url:string>>")
    found = F.slice(F.from_json(F.get_json_object(answer, "$.organic_results"), "array<struct<title:string,snippet:string,link:string>>"), 1, RESULTS)
    said = lambda r: F.regexp_replace(F.concat_ws("\n", F.coalesce(r["title"], F.lit("")), F.coalesce(r["snippet"], F.lit(""))), r"^\s+|\s+$", "")
    organic = F.coalesce(F.transform(found, lambda r: blob("organic", said(r), r["link"])), none)
    return F.filter(F.concat(box("answer_box"), box("knowledge_graph"), organic), lambda b: (b["text"] != "") & ~looks_like_price(b["text"]))


def best_numbers(blobs: DataFrame) -> DataFrame:
    """ask, region, value, url, snippet, is_model_level: the best blob's largest number, of each ask and region that has one.

    blobs: ask, model, generation, year, place (its order among the ask's blobs), text, url.  The first of equals wins.
    """
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("url", F.lit("")))
    rows = blobs.withColumn("said", text).withColumn("low", F.lower("said")).withColumn("value", F.array_max(candidate_numbers(F.col("said"))))
    spelled = F.exists(generation_aliases(F.col("generation")), lambda a: F.contains(F.col("low"), F.lower(a)))
    unnamed = F.trim(F.coalesce("generation", F.lit(""))) == ""
    rows = rows.where(has_sales_context(F.col("low")) & F.col("value").isNotNull() & (unnamed | spelled))
    rows = rows.withColumn("region", F.explode(F.array(*map(F.lit, REGIONS)))).withColumn("named", F.when(F.col("region") == "europe", _any(F.col("low"), REGIONS["europe"])).otherwise(_any(F.col("low"), REGIONS["world"])))
    rows = rows.where((F.col("region") == "europe") | F.col("named"))
    europe, country, part = F.col("region") == "europe", F.rlike("low", F.lit(COUNTRY)), F.rlike("low", F.lit(PART_OF_YEAR))
    model = F.contains(normalize_name(F.col("said")), normalize_name(F.col("model")))
    points = lambda condition, yes, no=0: F.when(condition, yes).otherwise(no)
    marks = (  # the weights are fixed values
        points(F.col("named"), 3) + points(model, 4, -2) + 2 + points(F.contains("low", F.col("year").cast("string")), 2, -2)
        + points(europe & country, -5) + points(part, -5) + points(europe & (F.col("value") < 20_000) & ~country, -6)
    )
    best = F.struct("value", "url", F.col("text").alias("snippet"), (model & ~country & ~part).alias("is_model_level"))
    rows = rows.select("ask", "region", best.alias("best"), F.struct((marks * 10 + F.log10(F.col("value") + 1)).alias("score"), (-F.col("place")).alias("place")).alias("order"))
    return rows.groupBy("ask", "region").agg(F.max_by("best", "order").alias("best")).select("ask", "region", "best.*")


def plausibility(prior_average: Column, model_total: Column) -> Column:
    """A note on a seed from the web: what local history it stands beside; null if there is none."""
    part = lambda n, said: F.when(n.isNotNull() & (n != 0), F.concat(F.lit(said), F.format_number(n, 0)))
    notes = F.concat_ws(" & ", part(prior_average, "10% prior-gen avg "), part(model_total, "5% model EU "))
    return F.when(notes != "", F.concat(F.lit("EU seed may be small vs "), notes))


def local_alias(labels: DataFrame, least: float = 0.7) -> DataFrame:
    """ask, alias: the one label that stands for a detected generation in local rows, else null.

    labels: ask, detected, year, start, end, generation.  Counted are labels in the window; the most frequent is taken if it is
    the only one or has this share, and none if the detected label is among them.  Of equals the lesser comes first.
    """
    label = normalize_generation_key(F.col("generation"))
    rows = labels.where("year between start and end").select("ask", normalize_generation_key(F.col("detected")).alias("detected"), label.alias("label")).where("label <> ''")
    per = rows.groupBy("ask", "label").agg(F.count("*").alias("n"), F.bool_or(F.col("label") == F.col("detected")).alias("known"))
    of = per.groupBy("ask").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.bool_or("known").alias("known"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("top"))
    alias = F.when(~F.col("known") & (F.col("most") >= least * F.col("all")), F.col("top"))
    return labels.select("ask").distinct().join(of, "ask", "left").select("ask", alias.alias("alias"))
