"""Phrase mining with compressed position bitmaps.

Texts are cut into shards, each of one language, and a shard numbers its words by position, with a gap where a piece
ends.  A word's bitmap marks the positions where it stands; only bytes that are not zero are held, with their numbers.
The bitmap of a longer phrase is that of its front and that of its end, shifted by one position: the AND of both, and a
popcount gives its occurrences in the shard.  A gap holds no word, so no phrase crosses it.

* Counts of words, summed over shards, give the frequent words; then pairs of frequent words are counted, and last, depth
  first in each shard, the phrases of three and four words all of whose pairs are frequent.  A phrase is never more
  frequent than its parts, so nothing is lost.
* What is frequent reaches the shards as a bitmap of FILTER_BITS hashed places, whatever the number of phrases.  A place
  that two share lets a rare phrase be counted in vain, no more: every count is exact and is compared with the limit
  after it has been summed.
* Words go by 64-bit hashes of language and word; should two words of the table share one, another seed is taken.

Defined edge cases: a null text has no words; a null language is `und`; repeated rows count each time; a language without
candidates gives no row; ties of score and occurrences go by the phrase's bytes; an empty table gives an empty result; other
columns are ignored.  Texts are worked on whole; a text longer than SHARD_BYTES is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread_join, table, text_or_empty, written

LEAST = 30
LONGEST = 4
#: A phrase is dropped if a longer one has this share of its occurrences, in percent.
INSIDE_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
#: Text of one language that a shard holds, and of all languages that a task keeps, in bytes.
SHARD_BYTES, TASK_BYTES = 2 << 20, 8 << 20
FILTER_BITS = 26
#: Positions whose candidates are intersected at once.
CHUNK = 1 << 16
#: Rows of a batch that leaves a worker.
ROWS = 1 << 16
#: No text in UTF-8 holds this byte; it stands for the end of a piece.
END = 0xFF
_BYTES = bytes(END if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    """Number of each distinct word, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The word's number at each position, -1 where a piece ends, and the words by number."""
    end = bytes([END])
    words = end.join(texts).translate(_BYTES).replace(end, b" \xff ").split()
    numbers = _Numbers({end: 0})
    at = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    return at - 1, list(numbers)[1:]


class Bitmaps(NamedTuple):
    """Bytes of many bitmaps that are not zero: their number in the bitmap, whose they are, their bits."""

    byte: np.ndarray
    owner: np.ndarray
    bits: np.ndarray


def bitmaps(at: np.ndarray) -> Bitmaps:
    """One bitmap for each number found in at; -1 is none."""
    places = np.flatnonzero(at >= 0)
    if not len(places):
        return Bitmaps(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))
    key = (places >> 3) << 32 | at[places]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bits = np.bitwise_or.reduceat((1 << (places[order] & 7)).astype(np.uint8), starts)
    return Bitmaps((key[starts] >> 32).astype(np.int32), (key[starts] & 0xFFFFFFFF).astype(np.int32), bits)


def shifted(maps: Bitmaps) -> Bitmaps:
    """Each bitmap moved down by one position."""
    inner, carried = maps.bits >> 1, (maps.bits & 1).astype(bool)
    some = inner > 0
    return Bitmaps(np.concatenate([maps.byte[some], maps.byte[carried] - 1]), np.concatenate([maps.owner[some], maps.owner[carried]]), np.concatenate([inner[some], np.full(carried.sum(), 128, np.uint8)]))


def extended(fronts: Bitmaps, ends: Bitmaps, tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
    """Every front joined with the ends that begin with its tail: front, end, occurrences and bitmaps of what occurs.

    tail and head: by owner, what a front must share with an end.
    """
    ends = shifted(ends)
    wide = int(max(tail.max(initial=0), head.max(initial=0))) + 1
    key = (ends.byte.astype(np.int64) + 1) * wide + head[ends.owner]  # a byte may be -1
    order = np.argsort(key, kind="stable")
    key, end_owner, end_bits = key[order], ends.owner[order], ends.bits[order]
    asked = (fronts.byte.astype(np.int64) + 1) * wide + tail[fronts.owner]
    low = np.searchsorted(key, asked, "left")
    many = np.searchsorted(key, asked, "right") - low
    found = []
    for a in range(0, len(asked), CHUNK):
        n = many[a : a + CHUNK]
        front = np.repeat(np.arange(a, a + len(n)), n)
        end = np.arange(len(front)) + np.repeat(low[a : a + CHUNK] - np.cumsum(n) + n, n)
        both = fronts.bits[front] & end_bits[end]
        some = both > 0
        front = front[some]
        found.append((fronts.byte[front], fronts.owner[front], end_owner[end[some]], both[some]))
    byte, front, end, bits = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 4))
    front = front.astype(np.int64)
    size = int(end.max(initial=0)) + 1
    pair, owner = np.unique(front * size + end, return_inverse=True)
    times = np.bincount(owner, np.bitwise_count(bits.astype(np.uint8)), len(pair)).astype(np.int64)
    return pair // size, pair % size, times, Bitmaps(byte, owner.astype(np.int32), bits.astype(np.uint8))


def place(hashes: list[Column]) -> Column:
    """Where a phrase stands in the filter."""
    out = F.lit(0).cast("long")
    for h in hashes:
        out = h.bitwiseXOR(F.shiftleft(out, 13)).bitwiseXOR(F.shiftright(out, 17))
    return out.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def frequent_filter(phrases: DataFrame, hashes: list[str]) -> bytes:
    """The filter's bits for the phrases, at most 2 ** FILTER_BITS / 8 bytes whatever their number."""
    at = phrases.select((place([F.col(h) for h in hashes]) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for part, bits in parts.collect():
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out.tobytes()


def _held(bits: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Whether the filter holds each phrase; its place is that of place()."""
    at = np.zeros(len(hashes[0]), np.int64)
    for h in hashes:
        at = h ^ (at << 13) ^ (at >> 17)
    at &= 8 * len(bits) - 1
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def shards(docs: DataFrame, seed: int) -> DataFrame:
    """lang, at (numbers by position, as bytes), words, hashes, times (by number) of each shard."""

    def shard(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        at, words = numbered_words(texts)
        mark = lang.encode("utf-8", "surrogatepass") + b"\0"
        hashes = np.fromiter((xxhash.xxh64_intdigest(mark + w, seed) for w in words), np.uint64, len(words)).view(np.int64)
        times = np.bincount(at[at >= 0], minlength=len(words))
        columns = [pa.array([lang]), pa.array([at.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([hashes], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "at", "words", "hashes", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                held.setdefault(lang, []).append(text.as_py())
                size = len(held[lang][-1]) + 1
                sizes[lang] = sizes.get(lang, 0) + size
                total += size
                full = [lang] if sizes[lang] > SHARD_BYTES else list(held) if total > TASK_BYTES else []
                for x in full:
                    total -= sizes.pop(x)
                    yield shard(x, held.pop(x))
        for lang, texts in held.items():
            yield shard(lang, texts)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "lang string, at binary, words array<binary>, hashes array<long>, times array<long>")


def _counted(rows: DataFrame, k: int) -> DataFrame:
    """h1 .. hk, n of the phrases that reach LEAST; rows: h1 .. hk, times of each shard's phrases."""
    return rows.groupBy(*[f"h{i}" for i in range(1, k + 1)]).agg(F.sum("times").alias("n")).where(F.col("n") >= LEAST)


def frequent_pairs(parts: DataFrame, words: bytes) -> DataFrame:
    """h1, h2, n of the frequent pairs; words: the filter of the frequent words."""
    kept = parts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(kept.value, np.uint8)
        for batch in batches:
            for k in range(len(batch)):
                hashes = batch.column("hashes")[k].values.to_numpy()
                if not len(hashes):
                    continue
                maps = bitmaps(_renumbered(batch.column("at")[k], _held(bits, [hashes])))
                none = np.zeros(len(hashes), np.int64)
                front, end, times, _ = extended(maps, maps, none, none)
                yield from _phrases([hashes[front], hashes[end]], times, 2)

    return _counted(parts.select("at", "hashes").mapInArrow(run, "h1 long, h2 long, times long"), 2)


def _renumbered(at: pa.Scalar, kept: np.ndarray) -> np.ndarray:
    """Numbers by position, -1 too for those not kept."""
    numbers = np.frombuffer(at.as_buffer(), np.int32)
    return np.where(np.append(kept, False)[numbers], numbers, -1)


def _phrases(hashes: list[np.ndarray], times: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """h1 .. hk, times; null for words that the phrases do not have."""
    names = [f"h{i}" for i in range(1, k + 1)] + ["times"]
    for a in range(0, len(times), ROWS):
        n = len(times[a : a + ROWS])
        columns = [pa.array(h[a : a + ROWS]) for h in hashes] + [pa.nulls(n, pa.int64())] * (k - len(hashes))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(times[a : a + ROWS])], names=names)


def frequent_longer(parts: DataFrame, pairs: bytes) -> DataFrame:
    """h1, h2, h3, h4 (null for phrases of three words), n of the frequent phrases of three and four words; pairs: the filter of the frequent pairs."""
    kept = parts.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(kept.value, np.uint8)
        for batch in batches:
            for k in range(len(batch)):
                hashes = batch.column("hashes")[k].values.to_numpy()
                if not len(hashes):
                    continue
                maps = bitmaps(np.frombuffer(batch.column("at")[k].as_buffer(), np.int32))
                none = np.zeros(len(hashes), np.int64)
                one, two, _, maps = extended(maps, maps, none, none)
                held = _held(bits, [hashes[one], hashes[two]])
                some = held[maps.owner]
                maps = Bitmaps(maps.byte[some], maps.owner[some], maps.bits[some])
                front, end, times, longer = extended(maps, maps, two, one)
                yield from _phrases([hashes[x] for x in (one[front], two[front], two[end])], times, LONGEST)
                # of four words: two of three, which share a pair
                a, b, times, _ = extended(longer, longer, end, front)
                yield from _phrases([hashes[x] for x in (one[front[a]], two[front[a]], two[end[a]], two[end[b]])], times, LONGEST)

    rows = parts.select("at", "hashes").mapInArrow(run, "h1 long, h2 long, h3 long, h4 long, times long")
    return _counted(rows, LONGEST)


def word_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shards, and lang, word, h, n of every word; no two words share a hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                lang = batch.column("lang")[k]
                columns = [batch.column(c)[k].values for c in ("words", "hashes", "times")]
                for a in range(0, len(columns[0]), ROWS):
                    parts = [x.slice(a, ROWS) for x in columns]
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(parts[0])), *parts], names=["lang", "word", "h", "times"])

    seed = 0
    while True:
        parts = written(shards(docs, seed), "shards")
        each = parts.select("lang", "words", "hashes", "times").mapInArrow(rows, "lang string, word binary, h long, times long")
        # a word's hash is one, so grouping by it too changes nothing and keeps it out of the aggregates
        words = written(each.groupBy("lang", "word", "h").agg(F.sum("times").alias("n")), "words")
        if not words.groupBy("h").count().where("count > 1").limit(1).count():
            return parts, words
        seed += 1


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hashes (one for each word), n of every phrase of one to LONGEST words that reaches LEAST, and lang, word, h, n of every word."""
    parts, words = word_table(docs)
    often = words.where(F.col("n") >= LEAST)
    pairs = written(frequent_pairs(parts, frequent_filter(often, ["h"])), "pairs")
    longer = frequent_longer(parts, frequent_filter(pairs, ["h1", "h2"]))
    out = often.select(F.array("h").alias("hashes"), "n").unionByName(pairs.select(F.array("h1", "h2").alias("hashes"), "n"))
    out = out.unionByName(longer.select(F.array_compact(F.array("h1", "h2", "h3", "h4")).alias("hashes"), "n"))
    return written(out, "phrases"), words


def mined(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    known, words = frequent_phrases(docs)
    size = F.size("hashes")
    asked = known.where(size > 1).select("hashes", F.col("n").alias("a"))
    cuts = asked.select("hashes", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("hashes", "a", "k", F.slice("hashes", F.lit(1), F.col("k")).alias("front"), F.slice("hashes", F.col("k") + 1, size - F.col("k")).alias("end"))
    cuts = spread_join(cuts, known.select(F.col("hashes").alias("front"), F.col("n").alias("l")), "front")
    cuts = spread_join(cuts, known.select(F.col("hashes").alias("end"), F.col("n").alias("r")), "end")
    score = F.expr(f"(cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.groupBy("hashes", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("hashes", "a", "cut.l", "cut.r", "cut.score")

    # every part of two words or more of a longer candidate, and the most frequent such candidate
    starts = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("hashes", i, n)))), lambda p: F.size(p) > 1)
    inside = asked.where(size > 2).select(F.explode(starts).alias("hashes"), "a").groupBy("hashes").agg(F.max("a").alias("longer"))
    kept = best.join(inside, "hashes", "left").where(F.coalesce(100 * F.col("longer") < INSIDE_PERCENT * F.col("a"), F.lit(True)))

    kept = spread_join(kept.withColumn("h", F.col("hashes")[0]), words.where(F.col("n") >= LEAST).select("h", "lang"), "h").drop("h")
    ranked = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    ranked = written(ranked.drop("place"), "ranked")
    spelled = ranked.select("hashes", F.posexplode("hashes").alias("i", "h")).join(words.where(F.col("n") >= LEAST).select("h", F.decode("word", "UTF-8").alias("word")), "h")
    spelled = spelled.groupBy("hashes").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = ranked.join(spelled, "hashes").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents").select("lang", "text"))


#: The same with every phrase spelled out.
OP12_SQL = r"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from piece
), gram as (
  select lang, 1 as k, unnest(w) as p from words
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words
  union all select lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) from words
), f as (
  select lang, k, p, count(*) as n from gram group by lang, k, p having k = 1 or count(*) >= 30
), total as (
  select lang, sum(n)::bigint as n from f where k = 1 group by lang
), candidate as (
  select lang, k, p, n as a, string_split(p, ' ') as w from f where k > 1 and n >= 30
), cuts as (
  select lang, p, a, j, array_to_string(w[1:j], ' ') as front, array_to_string(w[j + 1:], ' ') as back
  from (select *, unnest(range(1, k)) as j from candidate)
), cut as (
  select c.lang, c.p, a, j, x.n as l, y.n as r, ((2000000::hugeint * a) // (x.n + y.n))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.p = c.front join f y on y.lang = c.lang and y.p = c.back
), best as (
  select lang, p, a, l, r, score from cut qualify row_number() over (partition by lang, p order by score, j) = 1
), inside as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as p, max(a) as longer
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from candidate)) group by 1, 2
), kept as (
  select lang, p as phrase, a, l, r, score from best left join inside using (lang, p) where longer is null or 100 * longer < 80 * a
)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join total using (lang)
where rank <= 2000
"""
