"""Document fingerprints by order min-hash, in Spark's own functions only.

A text's five-word k-mers are hashed and numbered by occurrence, so that a repeated k-mer counts as often as it stands.
The hashes fall into BINS bins by their upper bits; in each bin the TUPLE least are selected, put back into text
order, and hashed together.  So a bin's value changes with the k-mers that it selects and with their order, and two
texts agree in the more bins the fewer edits lie between them.  This is the one-permutation form: the bins take the
place of independent permutations, and a k-mer is hashed once.

A fingerprint is BINS groups of four hex digits; a bin without a k-mer is `----`.  The likeness of two is the share of
equal bins among those that either fills, to the power 1 / TUPLE, which brings tuples back to the scale of k-mers.

Defined edge cases: a null text counts as empty; an empty text has the fingerprint of one empty word; a text of fewer
than five words is one k-mer; equal texts have equal fingerprints; a table of one document has itself as its next one;
rows that share a doc_id have the same next document, and the greatest of their texts stands for them as a next one;
a null doc_id comes after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, text_or_empty, written

KMER, TUPLE, BIN_BITS = 5, 2, 5
BINS = 1 << BIN_BITS
BLANK = "----"


def _bin(value: Column) -> Column:
    return F.shiftright(value, 64 - BIN_BITS)


def kmer_hashes(text: Column) -> Column:
    """The hashes of a text's k-mers, in order."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), "[ \t\n\x0b\f\r]+")

    def kmers(h: Column) -> Column:
        first = F.slice(h, F.lit(1), F.greatest(F.size(h) - (KMER - 1), F.lit(1)))
        return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, KMER)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), kmers)


def numbered(hashes: Column) -> Column:
    """The hashes labelled by occurrence: the first of a kind keeps its own, later ones mix in their number."""

    def label(s: Column) -> Column:
        runs = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | (e["x"] != F.get(s, i - 1)["x"]), i)), lambda i: i.isNotNull())
        nth = let(runs, lambda r: F.flatten(F.transform(r, lambda at, i: F.sequence(F.lit(0), F.coalesce(F.get(r, i + 1), F.size(s)) - at - 1))))
        back = let(nth, lambda n: F.sort_array(F.transform(s, lambda e, j: F.struct(e["i"].alias("i"), F.when(F.get(n, j) == 0, e["x"]).otherwise(F.xxhash64(e["x"], F.get(n, j))).alias("v")))))
        return F.transform(back, lambda e: e["v"])

    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(let(pairs(h), label)))


def fingerprint(text: Column) -> Column:
    """array<string> of BINS values."""

    def values(h: Column) -> Column:
        least = let(F.sort_array(h), lambda s: F.filter(s, lambda x, i: (i < TUPLE) | (_bin(F.get(s, i - TUPLE)) != _bin(x))))
        placed = F.sort_array(F.transform(least, lambda x: F.struct(_bin(x).alias("b"), F.array_position(h, x).alias("at"), x.alias("v"))))

        def bins(p: Column) -> Column:
            one = lambda e, i: F.substring(F.hex(F.xxhash64(e["v"], *[F.when(F.get(p, i + j)["b"] == e["b"], F.get(p, i + j)["v"]) for j in range(1, TUPLE)]).bitwiseOR(F.lit(1 << 62))), -4, 4)
            heads = F.filter(F.transform(p, lambda e, i: F.when((i == 0) | (F.get(p, i - 1)["b"] != e["b"]), F.struct(e["b"].alias("b"), one(e, i).alias("v")))), lambda e: e.isNotNull())
            # bins are in order, so the blanks before each head are the gap to the one before it
            filled = lambda q: F.flatten(F.concat(F.transform(q, lambda e, i: F.concat(F.array_repeat(F.lit(BLANK), (e["b"] - F.coalesce(F.get(q, i - 1)["b"], F.lit(-BINS // 2 - 1)) - 1).cast("int")), F.array(e["v"]))), F.array(F.array_repeat(F.lit(BLANK), (F.lit(BINS // 2 - 1) - F.element_at(q, -1)["b"]).cast("int")))))
            return let(heads, filled)

        return let(placed, bins)

    return let(numbered(kmer_hashes(text)), values)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == BLANK) & (y == BLANK), None).otherwise((x == y).cast("int")))
    known = F.filter(both, lambda x: x.isNotNull())
    return let(known, lambda k: F.pow(F.size(F.filter(k, lambda x: x == 1)) / F.size(k), F.lit(1.0 / TUPLE)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document."""
    return docs.select("doc_id", F.array_join(fingerprint(text_or_empty()), "").alias("fingerprint"))


def predecessors(docs: DataFrame) -> DataFrame:
    """doc_id, prev_id, prev_chars for each distinct doc_id: the document whose next one it is, by descending doc_id.

    Range partitioning orders the ids; only each partition's last row, one per partition, is ordered in one place.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.length(text_or_empty())).alias("n_chars"))
    ids = written(ids.repartitionByRange(F.desc_nulls_last("doc_id")).withColumn("part", F.spark_partition_id()), "ids")
    order = F.desc_nulls_last("doc_id")
    me = F.struct("doc_id", "n_chars")
    # the last in this order: the null id, if there is one, else the least
    lasts = ids.groupBy("part").agg(F.min_by(me, F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("last"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.last("last").over(every)).alias("before"))
    rows = ids.withColumn("prev", F.lag(me).over(Window.partitionBy("part").orderBy(order))).join(lasts, "part")
    rows = rows.withColumn("prev", F.coalesce("prev", F.struct("before.doc_id", "before.n_chars")))
    return written(rows.select("doc_id", F.col("prev.doc_id").alias("prev_id"), F.col("prev.n_chars").alias("prev_chars")), "predecessors")


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, prints, edited (the text with its last half replaced by the next document's first), next_prints."""
    before = predecessors(docs)
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("prints", fingerprint(F.col("text")))
    heads = base
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        heads = docs.groupBy("doc_id").agg(F.max(text_or_empty()).alias("text")).withColumn("prints", fingerprint(F.col("text")))
    # the halves go to the documents before them; only what is needed of a text travels
    heads = heads.join(before.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")))
    heads = heads.select("prev_id", F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 2).cast("int")).alias("half"), F.col("prints").alias("next_prints"))
    rows = base.join(heads, F.col("doc_id").eqNullSafe(F.col("prev_id")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("half", F.lit(1), half))
    return rows.select("doc_id", "text", "prints", edited.alias("edited"), "next_prints")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "prints", fingerprint(F.col("edited")).alias("edited_prints"), "next_prints")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("prints", "").alias("fingerprint"), F.array_join("edited_prints", "").alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
