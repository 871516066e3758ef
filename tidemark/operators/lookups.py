"""Joins beyond equality: as-of, interval choice, similar names, and what goes with keyed tables."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numbers import interval_distance
from ..functions.text import digit_tokens


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """left with `value` of the latest row of right whose `since` is not after `at`; of rows at one time the greatest value; null if there is none.

    Where only one time is asked for, one combining aggregate of what lies before it answers all.  Else both sides' distinct
    times are laid in one order by key; a slice of time holds at most what falls into it, and the last value before a slice is
    carried into it, so that a hot key is spread over its slices.  What is later than all that is asked is cut before any shuffle.
    """
    ends = left.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if ends["b"] is None:
        return left.withColumn(value, F.lit(None).cast(dict(right.dtypes)[value]))
    known = right.where(F.col(since) <= F.lit(ends["b"])).groupBy(key, F.col(since).alias("_t")).agg(F.max(value).alias("_v")) if ends["a"] < ends["b"] else None
    if known is None:
        last = right.where(F.col(since) <= F.lit(ends["b"])).groupBy(key).agg(F.max_by(value, F.struct(since, value)).alias(value))
        return left.join(last, key, "left").select(*left.columns, F.when(F.col(at).isNotNull(), F.col(value)).alias(value))
    wide = 365  # days in a slice
    slot = lambda c: F.floor(F.unix_timestamp(F.to_timestamp(c)) / (86400 * wide)).alias("_slot") if dict(left.dtypes)[at] not in ("int", "bigint") else F.floor(F.col(c) / wide).alias("_slot")
    asked = left.select(F.col(key), F.col(at).alias("_t")).distinct().select(key, "_t", F.lit(1).alias("_asked"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), slot("_t"))
    known = known.select(key, "_t", F.lit(0).alias("_asked"), "_v", slot("_t"))
    rows = asked.unionByName(known)
    w = Window.partitionBy(key, "_slot").orderBy("_t", "_asked")
    inside = rows.withColumn("_seen", F.last(F.when(F.col("_asked") == 0, F.struct("_v")), ignorenulls=True).over(w))
    lasts = known.groupBy(key, "_slot").agg(F.max_by(F.struct("_v"), "_t").alias("_last"))
    slots = rows.select(key, "_slot").distinct().join(lasts, [key, "_slot"], "left")
    before = slots.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)))
    found = inside.where("_asked = 1").join(before.select(key, "_slot", "_before"), [key, "_slot"]).select(key, F.col("_t").alias(at), F.coalesce("_seen", "_before")["_v"].alias(value))
    return left.join(found, [key, at], "left")


def pick_window(left: DataFrame, windows: DataFrame, key: str, year: str) -> DataFrame:
    """left with the window (label, start, end) of its key that fits its year.

    A window that covers the year comes first, the narrowest of them, then the one nearest; ties go to the later start,
    then the lesser label.  An open end counts as 9999.  Each key and year is asked once, and a combining aggregate picks, so that
    neither the windows nor the rows of a key are gathered.
    """
    end = F.coalesce("end", F.lit(9999))
    distance = interval_distance(F.col(year), F.col("start"), end)
    order = F.struct(distance.alias("a"), F.when(distance == 0, end - F.col("start")).otherwise(0).alias("b"), (-F.col("start")).alias("c"), "label")
    asked = left.select(key, year).distinct()
    best = asked.join(windows, key).groupBy(key, year).agg(F.min_by(F.struct("label", "start", "end"), order).alias("_best"))
    out = left.join(best, [key, year], "left")
    return out.select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in ("label", "start", "end")])


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key by position; a combining aggregate, so a hot key costs no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("x")).select(*keys, "x.*")


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("x")).select(*keys, "x.*")


def merge_upsert(old: DataFrame, new: DataFrame, key: str, replaced: list[str]) -> DataFrame:
    """old with the `replaced` columns of new where it has the key, and new's further rows."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in replaced])
    out = old.join(n, key, "full_outer")
    return out.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in replaced else F.col(c) for c in old.columns if c != key])


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the longest matching blocks of two names."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def grams(c: Column) -> Column:
    """What two names share one of if their ratio is 0.88 or more.

    Such names of T characters in all leave at most 0.12 T of them unmatched, which part the 0.44 T or more that match into
    blocks; one block has three characters at least.  Only where T is 9 may it have two.
    """
    n = F.length(c)
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array(c))
    return F.array_distinct(F.concat(cut(3), F.when(n.between(4, 5), cut(2)).otherwise(F.array().cast("array<string>"))))


def best_match(queries: DataFrame, keys: DataFrame, least: float = 0.88, by_digits: bool = True) -> DataFrame:
    """query, match, ratio: the most similar key of each query, at least `least` (0.88 or more); ties go to the lesser key.

    by_digits: where some key has the same digit words as the query, only such keys count.  Pairs are those that share
    a gram and whose lengths allow the ratio, so none is lost.  A query that is a key itself has its answer at once.  A gram is joined
    together with the lengths that the ratio allows, so that one that all names share meets only names of like length.
    """
    if least < 0.88:
        raise ValueError("grams() is lossless from a ratio of 0.88 on")
    digits = lambda c: F.array_join(digit_tokens(c), " ")
    known = keys.select("key", digits(F.col("key")).alias("key_digits")).distinct()
    asked = queries.select("query").distinct()
    exact = asked.join(known.select(F.col("key").alias("query")), "query", "left_semi").select("query", F.col("query").alias("match"), F.lit(1.0).alias("ratio"))
    asked = asked.join(known.select(F.col("key").alias("query")), "query", "left_anti").select("query", digits(F.col("query")).alias("digits"))
    some = known.select(F.col("key_digits").alias("digits")).where("digits <> ''").distinct().withColumn("strict", F.lit(True))
    asked = asked.join(some, "digits", "left")
    n, share = F.length("query"), least / (2 - least)  # the shorter name is this part of the longer at least
    lengths = F.sequence(F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share + 1e-9).cast("int"))
    mine = asked.withColumn("gram", F.explode(grams(F.col("query")))).withColumn("n", F.explode(lengths))
    if by_digits:  # a strict query meets keys of its digits alone, any other all keys
        mine = mine.withColumn("block", F.when(F.col("strict"), F.col("digits")).otherwise("*"))
        theirs = known.withColumn("gram", F.explode(grams(F.col("key")))).withColumn("n", F.length("key")).withColumn("block", F.explode(F.array_distinct(F.array("key_digits", F.lit("*")))))
        pairs = mine.join(theirs, ["gram", "n", "block"])
    else:
        pairs = mine.join(known.withColumn("gram", F.explode(grams(F.col("key")))).withColumn("n", F.length("key")), ["gram", "n"])
    scored = pairs.select("query", "key").distinct().select("query", "key", similarity("query", "key").alias("ratio")).where(F.col("ratio") >= least)
    near = scored.groupBy("query").agg(F.min(F.struct((-F.col("ratio")).alias("minus"), "key")).alias("x")).select("query", F.col("x.key").alias("match"), (-F.col("x.minus")).alias("ratio"))
    return exact.unionByName(near)


def find_keys(names: DataFrame, sources: dict[str, DataFrame], least: float = 0.88) -> DataFrame:
    """name, key, found_in: each name's key in the first source that has it, else the most similar key of all ('similar'), else null.

    names: name, key (normalised).  sources: tables of key, in the order they are looked through; each is looked through once.
    """
    held = None
    for place, (source, keys) in enumerate(sources.items()):
        one = keys.select("key").distinct().select("key", F.struct(F.lit(place).alias("place"), F.lit(source).alias("source")).alias("x"))
        held = one if held is None else held.unionByName(one)
    first = held.groupBy("key").agg(F.min("x")["source"].alias("found_in"))
    rows = names.join(first, "key", "left")
    near = best_match(rows.where("found_in is null").select(F.col("key").alias("query")).distinct(), first.select("key"), least)
    rows = rows.join(near.select(F.col("query").alias("key"), "match"), "key", "left")
    found = F.coalesce("found_in", F.when(F.col("match").isNotNull(), "similar"))
    return rows.select("name", F.when(F.col("found_in").isNotNull(), F.col("key")).otherwise(F.col("match")).alias("key"), found.alias("found_in"))


def dominant(rows: DataFrame, key: str, value: str, share: float = 0.7) -> DataFrame:
    """key, value, of: the value that holds at least `share` of its key's rows; other keys give no row."""
    per = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    top = per.groupBy(key).agg(F.max(F.struct("n", value)).alias("top"), F.sum("n").alias("of"))
    return top.where(F.col("top.n") >= share * F.col("of")).select(key, F.col(f"top.{value}").alias(value), "of")


def next_start_as_end(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, label, start, end) with open ends closed a year before the next start; the last stays open."""
    w = Window.partitionBy(key).orderBy("start", "label")
    return rows.withColumn("end", F.coalesce("end", F.lead("start").over(w) - 1))


def missing_years(rows: DataFrame, key: str, years: Column) -> DataFrame:
    """key, year for each year of the array `years` that a key lacks."""
    have = rows.groupBy(key).agg(F.collect_set("year").alias("_have"))
    return have.select(key, F.explode(F.array_except(years, F.col("_have"))).alias("year"))


#: The order in which languages are tried (fixed values).
LANGUAGES = ("en", "fr", "de", "es", "it", "pt")


def preferred_language(found: DataFrame, first: str = "en", least: int = 2) -> DataFrame:
    """found (model, lang, windows) with one row a model: the first language in order with `least` windows, else the first with any.

    The order is LANGUAGES with `first` before all others; languages that are not among them come last, by their names.
    """
    order = [first, *[x for x in LANGUAGES if x != first]]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("lang"))
    rank = F.struct((F.col("windows") < least).alias("few"), F.when(place > 0, place).otherwise(len(order) + 1).alias("place"), "lang")
    rest = [c for c in found.columns if c != "model"]
    return found.where("windows > 0").groupBy("model").agg(F.min_by(F.struct(*rest), rank).alias("x")).select("model", "x.*")
