"""Seeds and bounds of a sales estimate: shares of a parent model, bands by rank, exact values and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_generation_key, normalize_name, parent_candidate
from .lookups import best_match

#: The world total of a model that no estimate passes.
WORLD_CAP = 3_000_000
LAST_YEAR = 2035
# Low, middle and high share of a variant in its parent, in Europe and in the world.
SHARES = {
    "base": ((0.15, 0.25, 0.35), (0.12, 0.22, 0.32)),
    "body_style/sportback": ((0.25, 0.35, 0.45), (0.22, 0.32, 0.42)),
    "body_style/fastback": ((0.25, 0.35, 0.45), (0.22, 0.32, 0.42)),
    "body_style/hatchback": ((0.25, 0.35, 0.45), (0.22, 0.32, 0.42)),
    "body_style/coupe": ((0.18, 0.28, 0.38), (0.16, 0.26, 0.36)),
    "body_style/shooting_brake": ((0.18, 0.28, 0.38), (0.16, 0.26, 0.36)),
    "body_style/wagon": ((0.20, 0.30, 0.40), (0.18, 0.28, 0.36)),
    "body_style/cabrio": ((0.06, 0.12, 0.18), (0.05, 0.10, 0.15)),
    "performance/rs": ((0.06, 0.12, 0.20), (0.05, 0.11, 0.18)),
    "performance/amg": ((0.06, 0.12, 0.20), (0.05, 0.11, 0.18)),
    "performance/m": ((0.06, 0.12, 0.20), (0.05, 0.11, 0.18)),
    "performance/s": ((0.05, 0.10, 0.18), (0.04, 0.09, 0.16)),
    "performance/perf": ((0.05, 0.10, 0.18), (0.04, 0.09, 0.16)),
}


def share_priors(variant: Column) -> Column:
    """struct<eu, world>, each struct<low, mid, high>: the shares of a variant as classify_variant names it."""
    triple = lambda t: F.struct(*[F.lit(x).alias(n) for n, x in zip(("low", "mid", "high"), t)])
    held = F.create_map(*[x for k, (eu, world) in SHARES.items() for x in (F.lit(k), F.struct(triple(eu).alias("eu"), triple(world).alias("world")))])
    return F.coalesce(F.try_element_at(held, variant), F.element_at(held, F.lit("base")))


def share_band(rank: Column, presence: Column) -> Column:
    """struct<low, high>: Europe's share of the world by the model's rank in Europe, else by its years on the list (fixed values)."""
    band = lambda low, high: F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))
    ranked = F.when(rank <= 10, band(0.25, 0.85)).when(rank <= 30, band(0.15, 0.65)).when(rank <= 60, band(0.08, 0.50)).otherwise(band(0.03, 0.35))
    present = F.when(presence >= 5, band(0.08, 0.60)).when(presence >= 1, band(0.04, 0.40)).otherwise(band(0.01, 0.25))
    return F.when(rank.isNull(), present).otherwise(ranked)


def resolve_parents(names: DataFrame, keys: DataFrame, least: float = 0.90) -> DataFrame:
    """name, parent: the key (of keys.key) of each name's parent model; an exact one, else the most similar, else null."""
    candidate = parent_candidate(normalize_name(F.col("name")))
    tried = F.when(F.startswith(candidate, F.lit("bmw ")), F.array(candidate, F.concat(candidate, F.lit(" series")))).otherwise(F.array(candidate))
    rows = names.select("name", candidate.alias("candidate"), tried.alias("tried")).distinct()
    each = rows.select("name", F.posexplode("tried").alias("i", "x")).withColumn("key", normalize_name(F.col("x")))
    exact = each.join(keys.select("key").distinct(), "key").groupBy("name").agg(F.min_by("key", "i").alias("exact"))
    rows = rows.join(exact, "name", "left")
    near = best_match(rows.where("exact is null").select(F.col("candidate").alias("query")).distinct(), keys, least, by_digits=False)
    return rows.join(near, F.col("candidate") == F.col("query"), "left").select("name", F.coalesce("exact", "match").alias("parent"))


def zero_years(year: Column, start: Column, end: Column, first: int = 1990) -> Column:
    """The years outside a window in which nothing is sold, from `year` on."""
    return F.filter(F.concat(F.sequence(F.lit(first), F.lit(LAST_YEAR))), lambda y: (y >= year) & ((y < start) | (y > end)))


def constraints(rows: DataFrame) -> DataFrame:
    """rows with exact values and ranges at the start year, for Europe and the world.

    rows: eu, world (local seeds), parent, parent_eu, parent_world, variant, has_history, web_eu, web_world, rank, presence.
    A seed that is missing, or below the low share of the parent's total, is derived from the parent by the middle share and
    kept to the high one; the web's seed counts only where nothing else does.
    """
    p = share_priors(F.col("variant"))
    total = {"eu": F.col("parent_eu"), "world": F.col("parent_world")}
    seed = {"eu": F.col("eu"), "world": F.col("world")}
    lacks = lambda r: total[r].isNotNull() & (seed[r].isNull() | (seed[r] < p[r]["low"] * total[r]))
    derive = F.col("parent").isNotNull() & (lacks("eu") | lacks("world"))
    share = lambda r, s: F.rint(p[r][s] * total[r]).cast("long")
    nothing = F.col("eu").isNull() & F.col("world").isNull() & F.col("parent").isNull() & ~F.col("has_history")
    value = {r: F.when(derive & total[r].isNotNull(), F.least(F.greatest(share(r, "mid"), seed[r]), share(r, "high"))).when(nothing, F.col(f"web_{r}")).otherwise(seed[r]) for r in seed}
    out = rows.withColumns({"eu_exact": value["eu"], "world_value": value["world"]}).withColumn("world_exact", F.when(F.col("world_value").isNotNull(), F.least("world_value", F.lit(WORLD_CAP))))
    banded = F.col("parent").isNotNull()
    value = {"eu": F.col("eu_exact"), "world": F.col("world_value")}
    low = {r: F.when(banded & total[r].isNotNull(), F.greatest(share(r, "low"), F.lit(0).cast("long"))) for r in seed}
    high = {r: F.when(banded & total[r].isNotNull(), F.greatest(share(r, "high"), low[r], F.coalesce(value[r], F.lit(0).cast("long")))) for r in seed}
    open_world = F.col("world_value").isNull() & F.col("eu_exact").isNotNull()
    band = share_band(F.col("rank"), F.col("presence"))
    world_low = F.when(open_world, F.greatest(F.col("eu_exact"), F.ceil(F.col("eu_exact") / band["high"]))).otherwise(low["world"])
    world_high = F.when(open_world, F.least(F.lit(WORLD_CAP).cast("long"), F.floor(F.col("eu_exact") / band["low"]))).otherwise(high["world"])
    return out.withColumns({"eu_low": low["eu"], "eu_high": high["eu"], "world_low": world_low, "world_high": world_high}).drop("world_value")


# What says that a model ends with 2025, and that it goes on.
STOPS = ("production ended in 2025", "discontinued in 2025", "final model year 2025", "end of production 2025")
GOES_ON = ("2026 model year", "MY2026", "MY 2026", "continues into 2026", "facelift 2026", "carryover 2026")


def continued_end(windows: DataFrame, blobs: DataFrame, reference: int = 2025) -> DataFrame:
    """model, end: windows that end with the reference year, moved by what texts (model, text) say.

    A stop keeps the end, a sign of going on adds two years, silence one; other ends stay.  Marks are looked for in the
    lower-cased text as they are written here, so those with capitals are never found there.
    """
    says = lambda words: F.bool_or(F.coalesce(F.rlike(F.lower("text"), F.lit("|".join(words))), F.lit(False)))
    told = blobs.groupBy("model").agg(says(STOPS).alias("stop"), says(GOES_ON).alias("on"))
    end = F.when((F.col("end") != reference) | F.coalesce("stop", F.lit(False)), F.col("end")).when(F.coalesce("on", F.lit(False)), F.least(F.lit(reference + 2), F.lit(LAST_YEAR))).otherwise(F.least(F.lit(reference + 1), F.lit(LAST_YEAR)))
    return windows.join(told, "model", "left").select("model", end.cast("long").alias("end"))


def parent_totals(asked: DataFrame, world: DataFrame, europe: DataFrame) -> DataFrame:
    """name, year, parent, eu, world: the parent of each name, and its totals in the year; asked: name, year.

    world: key, year, world; europe: key, year, eu.  Parents are looked for among the keys of both.  A name that is its own
    parent has none, and no totals.
    """
    parents = resolve_parents(asked.select("name").distinct(), world.select("key").union(europe.select("key")).distinct())
    rows = asked.join(parents, "name", "left").withColumn("parent", F.when(F.col("parent") != normalize_name(F.col("name")), F.col("parent")))
    at = lambda t: t.withColumnRenamed("key", "parent")
    return rows.join(at(europe), ["parent", "year"], "left").join(at(world), ["parent", "year"], "left").select("name", "year", "parent", "eu", "world")


def local_seeds(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """model, start, seed, source, history, history_units of each asked model.

    asked: model, start, first, final (its window), accepted (normalised labels).  rows: model, year, units, generation: one row a
    year.  The seed is the start year's units, under another label too, which its source tells; history are the years in the window.
    """
    label = normalize_generation_key(F.col("generation"))
    met = asked.join(rows, "model", "left")
    seed = F.max(F.when(F.col("year") == F.col("start"), F.struct(F.col("units"), F.when(F.array_contains("accepted", label), "local-db").otherwise("local-db(year-match)").alias("source"))))
    inside = F.when(F.col("year").between(F.col("first"), F.col("final")), F.col("units"))
    out = met.groupBy("model", "start").agg(seed.alias("s"), F.count(inside).alias("history"), F.coalesce(F.sum(inside), F.lit(0)).alias("history_units"))
    return out.select("model", "start", F.col("s.units").alias("seed"), "s.source", "history", "history_units")
