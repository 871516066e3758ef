"""An estimate from end to end, for many models at once: window, seeds, constraints, enforcement, smoothing, fleets and support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify_variant, normalize_generation_key, normalize_name
from ..storage import stored
from . import detection, enforcement, estimates, evidence, lookups, publish, support

FIRST_YEAR = 1990


def web_seed(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """ask, region, value, url, snippet, is_model_level: the best figures of what searches for each ask have found.

    asked: ask, model, generation, year.  answers: query, response (JSON), as a provider gave them.  The seven searches of an ask are
    joined with the answers by their text, each search once whatever the number of asks that share it.
    """
    searches = asked.select("ask", "model", "generation", "year", F.posexplode(evidence.search_queries(F.col("model"), F.col("generation"), F.col("year"))).alias("nth", "query"))
    wanted = answers.join(searches.select("query").distinct(), "query", "left_semi").groupBy("query").agg(F.max("response").alias("response"))
    found = wanted.select("query", F.posexplode(evidence.text_blobs(F.col("response"))).alias("i", "b")).select("query", "i", "b.text", "b.url")
    # an answer has two boxes and ten results at most whose texts are read, so a place is a search's number and the text's
    blobs = searches.join(found, "query").withColumn("place", F.col("nth") * 10_000 + F.col("i"))
    return evidence.best_numbers(blobs.select("ask", "model", "generation", "year", "place", "text", "url"))


def ranked(history: DataFrame) -> DataFrame:
    """key, year, rank, presence of Europe's rows: the place in the year by units, and in how many years the key stands."""
    local = history.where("region = 'EU'")
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("units"), "key"))
    presence = local.groupBy("key").agg(F.count("*").cast("int").alias("presence"))
    return local.select("key", "year", rank.alias("rank")).join(presence, "key")


def estimate(asked: DataFrame, history: DataFrame, cached: DataFrame, pages: DataFrame, texts: DataFrame, catalogue: DataFrame, answers: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """Windows, Constraints, Estimates and Fleet_Repairs of each ask (ask, model, year, generation); in the sheets `model` is the ask.

    history: `sources.sales_lists.keyed_history`.  cached, pages, texts: as `detection.detect` takes them.  catalogue: key, from_year,
    code.  answers: as `web_seed` takes them.  proposals: ask, year, world, europe, rationale, as whoever proposes yearly figures
    gave them.  Everything is joined by ask or by key; nothing is looked up ask by ask.
    """
    windows = detection.detect(asked, cached, pages, texts)
    keys = {r: history.where(F.col("region") == r).select("key") for r in ("EU", "World")}
    named = asked.select(F.col("ask").alias("name"), normalize_name(F.col("model")).alias("key"))
    found = lookups.find_keys(named, keys).select(F.col("name").alias("ask"), "key")
    base = stored(asked.select("ask", "model").join(windows, "ask").withColumn("launch", F.greatest(F.lit(FIRST_YEAR), "start")).join(found, "ask", "left"), "asked")

    # local figures in the window, and at its first year
    rows = base.select("ask", "launch", "start", "end", "label", "key").join(history, "key")
    inside = F.col("year").between(F.col("start"), F.col("end"))
    at = lambda region, v: F.max(F.when((F.col("region") == region) & (F.col("year") == F.col("launch")), v))
    same = normalize_generation_key(F.col("generation")) == normalize_generation_key(F.col("label"))
    source = F.when(same, "local-db").otherwise("local-db(year-match)")
    seeds = rows.groupBy("ask").agg(at("EU", F.col("units")).alias("eu"), at("World", F.col("units")).alias("world"), at("EU", source).alias("eu_source"), F.bool_or(inside).alias("has_history"))

    total = lambda region, name: history.where(F.col("region") == region).select("key", F.col("year").cast("int").alias("year"), F.col("units").alias(name))
    parents = estimates.parent_totals(base.select(F.col("model").alias("name"), F.col("launch").alias("year")).distinct(), total("World", "parent_world").withColumnRenamed("parent_world", "world"), total("EU", "eu"))
    parents = parents.select(F.col("name").alias("model"), F.col("year").alias("launch"), "parent", F.col("eu").alias("parent_eu"), F.col("world").alias("parent_world"))
    places = ranked(history)
    web = web_seed(base.select("ask", "model", F.col("label").alias("generation"), F.col("launch").alias("year")), answers).groupBy("ask").agg(*[F.max(F.when(F.col("region") == r, F.col("value"))).alias(f"web_{n}") for r, n in (("europe", "eu"), ("world", "world"))])
    cases = base.join(seeds, "ask", "left").join(parents, ["model", "launch"], "left").join(web, "ask", "left")
    cases = cases.join(places.select("key", F.col("year").alias("launch"), "rank"), ["key", "launch"], "left").join(places.select("key", "presence").distinct(), "key", "left")
    cases = cases.withColumn("variant", classify_variant(normalize_name(F.col("model")))).withColumn("has_history", F.coalesce("has_history", F.lit(False))).withColumn("presence", F.coalesce("presence", F.lit(0)))
    held = stored(estimates.constraints(cases), "constraints")

    # one row for each limit; the world's range counts where it has no exact value
    limit = lambda region, kind, low, high: F.when(F.col(low).isNotNull(), F.struct(F.lit(region).alias("region"), F.lit(kind).alias("kind"), F.col(low).cast("long").alias("low"), F.col(high).cast("long").alias("high")))
    each = F.array_compact(F.array(limit("europe", "exact", "eu_exact", "eu_exact"), limit("world", "exact", "world_exact", "world_exact"), limit("world", "range", "world_low", "world_high")))
    limits = held.select(F.col("ask").alias("model"), F.col("launch").alias("year"), F.explode(each).alias("l")).select("model", "year", "l.*", F.lit(1).alias("precedence"))
    spans = base.select(F.col("ask").alias("model"), F.col("launch").alias("start"), F.col("start").alias("first"), F.col("end").alias("final"))
    enforced = stored(enforcement.enforce(proposals.withColumnRenamed("ask", "model"), spans, limits), "enforced")
    enforced = enforced.join(spans.select("model", "start"), "model").where(F.col("year") >= F.col("start"))
    smooth = enforcement.smooth_pair(enforced).join(enforced.select("model", "year", "rationale"), ["model", "year"])
    answer = support.support(base.select("ask", normalize_name(F.col("model")).alias("key"), F.col("label").alias("generation"), F.col("launch").alias("year")), catalogue)
    sheets = publish.estimate_sheets(stored(smooth, "smooth"), spans.select("model", "first", "final"), answer.select(F.col("ask").alias("model"), "supported", "match_type"))
    return {"Windows": windows, "Constraints": held.select("ask", "launch", "parent", "variant", "eu_source", "eu_exact", "world_exact", "eu_low", "eu_high", "world_low", "world_high"), **sheets}

