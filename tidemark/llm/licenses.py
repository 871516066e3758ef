"""Licence scans by ordered signature rules, in Spark's own functions only.

A text is brought to lower-case words parted by single spaces.  Each rule is gated by keywords: only the patterns of
which one stands in a text are tried on it, and each alternative of a pattern has one.  Their detections are intervals
with a priority.  One that lies inside a better one that stays is suppressed: better is a lesser priority number, or the same
and a longer interval.  So a detection that is itself suppressed takes nothing with it, and a better one inside a worse one leaves
both.  Labels are those of the detections that stay, and always those of the base phrases.  A clause that names its holder is
found if the name takes at most 400 characters.

Defined edge cases: a null text counts as empty and has no words, places or labels, and score 0; ties go to the longer
interval, then the better priority, then the lesser label; repeated rows each give a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, sums_before, table, text_or_empty
from .license_rules import WEIGHTS, rules

#: The places that the contract counts: words that stand consecutively, and their label.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text: Column) -> Column:
    """The text's words in lower case (A-Z only), each between single spaces; a single space if there are none."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    inner = F.btrim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    return let(inner, lambda x: F.when(x == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), x, F.lit(" "))))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_places(norm: Column) -> Column:
    """array<struct<label, n, first, last>> of the base phrases that stand in a text: how often, and from which words."""

    def one(phrase: str, label: str) -> Column:
        def counted(pieces: Column) -> Column:
            last = F.length(norm) - F.length(F.element_at(pieces, -1)) - len(phrase)
            word = lambda at: (spaces(F.substring(norm, F.lit(1), at)) - 1).cast("long")
            return F.struct(F.lit(label).alias("label"), (F.size(pieces) - 1).cast("long").alias("n"), word(F.length(F.element_at(pieces, 1))).alias("first"), word(last).alias("last"))

        return F.when(F.contains(norm, F.lit(f" {phrase} ")), let(F.split(norm, f"(?<= ){phrase}(?= )"), counted))

    return F.filter(F.array(*[one(p, x) for p, x in BASE_PHRASES.items()]), lambda x: x.isNotNull())


def rule_table() -> Column:
    return F.from_json(F.lit(json.dumps([r | {"weight": WEIGHTS[r["priority"]]} for r in rules()])), "array<struct<label:string,priority:int,gates:array<string>,pattern:string,weight:double>>")


def detections(norm: Column, gated: Column) -> Column:
    """array<struct<start, back, priority, label, weight>> of the rules' matches, in order; back is minus the end."""

    def of(rule: Column) -> Column:
        def placed(found: Column, pieces: Column) -> Column:
            def span(start: Column, m: Column) -> Column:
                return F.struct(start.alias("start"), (-start - F.length(m)).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"))

            before = sums_before(F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m)))
            return let(before, lambda at: F.transform(found, lambda m, i: let(F.get(at, i) + F.length(F.get(pieces, i)), lambda start: span(start, m))))

        return let(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(norm, rule["pattern"]), lambda pieces: placed(found, pieces))))

    return F.array_sort(F.flatten(F.filter(F.transform(gated, of), lambda x: x.isNotNull())))


def resolved(found: Column) -> Column:
    """struct<labels, score, n>: what stays after priority and containment.

    A detection goes only if one that stays holds it whole and is better: of a lesser priority number, or of the same and longer
    or the first of equals.  All that may hold a detection stand before it in the order of starts and, of one start, of falling
    ends, so one pass decides; it keeps, for each priority, how far those that stay have come.
    """
    most = max(WEIGHTS)
    none = F.array_repeat(F.lit(-1), most)
    first = F.struct(none.alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        kept = F.struct(
            F.transform(acc["ends"], lambda v, i: F.when(i + 1 == x["priority"], F.greatest(v, end)).otherwise(v)).alias("ends"),
            F.array_union(acc["labels"], F.array(x["label"])).alias("labels"), F.greatest(acc["score"], x["weight"]).alias("score"), (acc["n"] + 1).alias("n"),
        )
        return F.when(F.array_max(F.slice(acc["ends"], F.lit(1), x["priority"])) < end, kept).otherwise(acc)

    return F.aggregate(found, first, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score"), acc["n"].alias("n")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every document."""
    gates = sorted({g for r in rules() for g in r["gates"]})
    rows = docs.select("doc_id", words(text_or_empty()).alias("norm"))
    norm = F.col("norm")
    hits = let(F.array(*map(F.lit, gates)), lambda all_: F.filter(all_, lambda g: F.contains(norm, g)))
    rows = rows.withColumn("rules", rule_table()).withColumn("hits", hits)
    gated = F.filter("rules", lambda r: F.arrays_overlap(F.col("hits"), r["gates"]))
    none = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("n"))
    some = F.size("hits") > 0
    rows = rows.select(
        "doc_id", F.when(norm == " ", 0).otherwise(spaces(norm) - 1).cast("long").alias("n_words"),
        F.when(some, base_places(norm)).otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")).alias("base"),
        F.when(some, resolved(detections(norm, gated))).otherwise(none).alias("method"),
    )
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform("base", lambda b: b["label"])
    return rows.select(
        "doc_id", "n_words", F.aggregate("base", F.lit(0).cast("long"), lambda acc, b: acc + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, F.col("method.labels"))).alias("labels"),
        F.greatest(F.col("method.score"), F.when(F.size("base") > 0, F.lit(WEIGHTS[4])).otherwise(F.lit(0.0))).alias("score"), F.col("method.n").alias("n_detections"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
