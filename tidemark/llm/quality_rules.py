"""Quality rules: plain text measures, then lines that too many documents of a host share.

Lines are normalised and hashed.  For each host (the `source` column) the documents that hold a line are counted;
a line above the host's limit is boilerplate, is removed, and a document that loses too much of itself is rejected.
Documents are told apart by a hash of all their words in order, so that exact copies of one text count as one document
and a large group of them does not make its own lines look like boilerplate; near copies each count.

Defined edge cases: a null text has no words and fails the base rules; a null source is a host of its own; repeated
rows each get the same verdict; an empty table gives an empty result; other columns are ignored, and kept by
`filter_documents`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: A line is boilerplate in more than this many documents of its host, and in more than this share of them.
LINE_DOCUMENTS = 20
LINE_SHARE = 0.03
#: A document is depleted if it keeps less than this share of its words.
KEEP_SHARE = 0.3
#: Boilerplate lines that may be broadcast (some 30 bytes each); a larger table is joined by a shuffle.
BROADCAST_LINES = 100_000

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile("[0-9]+")


class _Index(dict):
    """Number of each distinct word, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def normal_line(line: str) -> str:
    """Case, digits, and white space around and within a line do not tell lines apart."""
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(normal_line(line)) - (1 << 63)


def _repeated(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each text that lie in windows of WINDOW words which the text holds twice or more; exact."""
    n = len(ids)
    total = np.zeros(len(ends), np.int64)
    if n < WINDOW:
        return total
    rank, span = ids.astype(np.uint64), 1
    while span < WINDOW:  # rank of the window twice as long, from the ranks of its halves
        _, rank = np.unique(rank[:-span] << np.uint64(32) | rank[span:], return_inverse=True)
        rank, span = rank.astype(np.uint64), 2 * span
    text = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    inside = np.flatnonzero(text[: len(rank)] == text[WINDOW - 1 :])
    _, same, count = np.unique(text[inside].astype(np.uint64) << np.uint64(32) | rank[inside], return_inverse=True, return_counts=True)
    starts = inside[count[same] > 1]
    cover = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    covered = np.flatnonzero(np.cumsum(cover)[:n] > 0)
    return total + np.bincount(text[covered], minlength=len(ends))


def measure_texts(texts: list[str]) -> dict[str, list]:
    """The measures of each text: base figures, its identity, and its distinct lines with their words."""
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "same_as", "lines")}
    index, ids = _Index(), []
    for text in texts:
        raw = text.encode("utf-8", "replace")
        words = raw.split()  # bytes split on the six ASCII blanks only
        ids.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        out["n_words"].append(len(words))
        out["same_as"].append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63))
        out["word_chars"].append(len(text) - (len(raw) - len(raw.translate(None, BLANKS))))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        held: dict[int, int] = {}
        for line in lines:
            h = line_hash(line)
            held[h] = held.get(h, 0) + len(line.encode("utf-8", "replace").split())
        out["lines"].append([{"line": k, "words": v} for k, v in held.items()])
    ends = np.cumsum(out["n_words"], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    out["n_repeat_words"] = _repeated(flat, ends).tolist()
    return out


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, same_as long, lines array<struct<line:long,words:long>>"


def row_key() -> Column:
    """Names a row by what its verdict depends on; equal rows share it."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("\n", *parts))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: key, doc_id, host and the measures, computed in one pass over the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"lines": pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))}
        order = [x.split(" ")[0] for x in _MEASURES.split(", ")]
        for batch in slices(batches):
            found = measure_texts([t or "" for t in batch.column("text").to_pylist()])
            kept = [batch.column(c) for c in ("key", "doc_id", "host")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(found[c], kinds.get(c, pa.int64())) for c in order], names=["key", "doc_id", "host", *order])

    rows = docs.select(row_key().alias("key"), "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key string, doc_id {id_type}, host string, {_MEASURES}")


def common_lines(measured: DataFrame) -> DataFrame:
    """host, line: the lines above their host's limit."""
    held = measured.select("host", "same_as", F.explode("lines.line").alias("line"))
    per_line = held.groupBy("host", "line", "same_as").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("documents"))
    hosts = measured.groupBy("host", "same_as").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
    return per_line.where(F.col("documents") > LINE_DOCUMENTS).join(hosts, "host").where(F.col("documents") > LINE_SHARE * F.col("of")).select("host", "line")


def verdicts(docs: DataFrame) -> DataFrame:
    """The measures of every document with base_failed, kept, and the hashes of the lines to remove."""
    spark = docs.sparkSession
    measured = written(measure(docs).withColumn("rid", F.monotonically_increasing_id()), "measured")
    common = written(common_lines(measured), "common_lines")
    if common.count() <= BROADCAST_LINES:
        common = F.broadcast(common)
    lost = measured.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", "x.line", "x.words").join(common, ["host", "line"])
    lost = lost.groupBy("rid").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    rows = measured.drop("lines", "same_as").join(lost, "rid", "left")
    rows = rows.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < KEEP_SHARE * F.col("n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def remove_lines(rows: DataFrame) -> DataFrame:
    """Rows of (row, text, removed_lines) with the text cleaned of those lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("removed_lines").to_pylist()):
                if lines and text:
                    gone = set(lines)
                    text = "\n".join(x for x in text.split("\n") if not x.strip(" \t\n\x0b\x0c\r") or line_hash(x) not in gone)
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return rows.mapInArrow(run, rows.schema)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their boilerplate lines; the columns of docs, n_chars brought up to date."""
    judged = verdicts(docs)
    passed = judged.where("kept").groupBy("key").agg(F.first("removed_lines").alias("removed_lines"))
    # the columns of docs travel in a struct, so that no name of theirs can clash
    rows = docs.select(row_key().alias("key"), F.col("text").cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"))
    rows = rows.join(passed, "key").select("row", "text", "removed_lines")
    fixed = remove_lines(rows.where(F.col("removed_lines").isNotNull()))

    def shown(c: str, changed: bool) -> Column:
        kind = docs.schema[c].dataType
        if c == "text":
            return F.col("text").cast(kind).alias(c)
        return F.length("text").cast(kind).alias(c) if c == "n_chars" and changed else F.col("row")[c].alias(c)

    parts = [(rows.where(F.col("removed_lines").isNull()), False), (fixed, True)]
    same, cleaned = [df.select(*[shown(c, changed) for c in docs.columns]) for df, changed in parts]
    return same.unionByName(cleaned)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
