"""Yearly estimates held to their constraints, and smoothed over a life cycle, Europe beside the world."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import UNITS_CAP, clamp
from .estimates import LAST_YEAR

# What is added to the reason of a year that was changed.
EUROPE_FIXED, WORLD_FIXED, FILLED, OUTSIDE = "Europe start fixed.", "World start fixed.", "Filled by client.", "Outside generation window -> zero."
#: Growth by years since the first: +35 %, twice +12 %, twice +5 %, then -8 % (fixed values).
GROWTH = ((1, 0.35), (3, 0.12), (5, 0.05))
DECLINE, KEPT = -0.08, 0.6


def enforce(estimates: DataFrame, windows: DataFrame, limits: DataFrame, last: int = LAST_YEAR) -> DataFrame:
    """model, year, world, europe, rationale, zero: estimates held to limits, one row a year from the start year to `last`.

    estimates: model, year, world, europe, rationale.  windows: model, start (the first year asked for), first, final (the
    generation's years).  limits: model, region ('europe' or 'world'), kind ('exact' or 'range'), year, low, high, precedence.

    All three are laid over each other in one union and brought together by one aggregate on model and year, which combines
    before its shuffle; of limits of one kind that with the least precedence number counts.  At the start year an exact value
    replaces the estimate, else the world is kept within its range, whose ends give way to Europe's figure, and the world is
    never below Europe.  Years that lack an estimate become 0.  Years outside the generation's window are 0 from the start
    year on, save those that an exact value protects.  Estimates of models without a window stay as they are.
    """
    reason = F.coalesce("rationale", F.lit(""))
    given = estimates.select("model", F.col("year").cast("int").alias("year"), F.struct("world", "europe", reason.alias("rationale")).alias("e"))
    years = F.explode(F.sequence(F.col("start").cast("int"), F.lit(last)))
    asked = windows.select("model", years.alias("year"), F.struct("start", "first", "final").alias("w"))
    held = limits.select("model", F.col("year").cast("int").alias("year"), F.struct("region", "kind").alias("of"), F.struct("precedence", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).alias("l"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (given, asked, held))
    first = lambda region, kind: F.min(F.when((F.col("of.region") == region) & (F.col("of.kind") == kind), F.col("l")))
    names = {"eu": first("europe", "exact"), "world": first("world", "exact"), "band": first("world", "range")}
    met = rows.groupBy("model", "year").agg(F.max("e").alias("e"), F.max("w").alias("w"), *[v.alias(k) for k, v in names.items()])
    met = met.where("e is not null or w is not null")

    start = F.col("year") == F.col("w.start")
    europe = F.coalesce(F.when(start, F.col("eu.low")), F.col("e.europe"), F.lit(0)).cast("long")
    estimated = F.coalesce("e.world", F.lit(0)).cast("long")
    low = F.greatest(F.col("band.low"), europe)
    banded = F.when(F.col("band").isNotNull(), clamp(estimated, low, F.greatest(F.col("band.high"), low))).otherwise(estimated)
    world = F.when(start, F.greatest(F.coalesce(F.col("world.low"), banded), europe)).otherwise(estimated)
    outside = F.coalesce(~F.col("year").between(F.col("w.first"), F.col("w.final")), F.lit(False))
    zero = outside & F.col("eu").isNull() & F.col("world").isNull()
    said = F.array(
        F.when(F.col("e").isNotNull(), F.col("e.rationale")).when(~start, F.lit(FILLED)), F.when(start & F.col("eu").isNotNull(), EUROPE_FIXED),
        F.when(start & F.col("world").isNotNull(), WORLD_FIXED), F.when(zero, OUTSIDE),
    )
    none = F.lit(0).cast("long")
    return met.select(
        "model", "year", F.when(zero, none).otherwise(world).alias("world"), F.when(zero, none).otherwise(europe).alias("europe"),
        F.trim(F.array_join(F.filter(said, lambda x: x != ""), " ")).alias("rationale"), outside.alias("zero"),
    )


def smooth_pair(rows: DataFrame, cap: int = UNITS_CAP) -> DataFrame:
    """model, year, world, europe: both series smoothed year by year in one fold, then the world capped and Europe kept to it.

    rows: model, year, world, europe, zero.  Each year mixes six tenths of growth on the year before's output with four
    tenths of its own figure; a zero year gives 0 and the next grows from there.  The first year of a model stays, if it is not
    below 0.  The fold carries both outputs before the cap, as the cap must not slow what follows.  A model has as many
    rows as calendar years, so its array is small.
    """
    series = rows.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("year", "world", "europe", "zero"))).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last, since = F.element_at(acc, -1), x["year"] - acc[0]["year"]
        growth = reduce(lambda c, g: c.when(since <= g[0], g[1]), GROWTH[1:], F.when(since == GROWTH[0][0], GROWTH[0][1])).otherwise(DECLINE)

        def mixed(name: str) -> Column:
            grown = F.greatest(F.lit(KEPT) * F.rint(last[name] * (1 + growth)) + F.lit(1 - KEPT) * x[name], F.lit(0.0)).cast("long")
            return F.when(x["zero"], F.lit(0).cast("long")).otherwise(grown).alias(name)

        return F.concat(acc, F.array(F.struct(x["year"].alias("year"), mixed("world"), mixed("europe"))))

    first = F.get("s", F.lit(0))
    start = F.array(F.struct(first["year"].alias("year"), *[F.greatest(first[c].cast("long"), F.lit(0).cast("long")).alias(c) for c in ("world", "europe")]))
    out = series.select("model", F.explode(F.aggregate(F.slice("s", F.lit(2), F.size("s")), start, step)).alias("x"))
    world = F.least("x.world", F.lit(cap)).cast("long")
    return out.select("model", "x.year", world.alias("world"), F.least("x.europe", world).alias("europe"))
