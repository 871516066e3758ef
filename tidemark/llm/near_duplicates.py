"""Near-duplicate classes by order min-hash, verified by banded alignment.

* Texts are sequences of white-space delimited words; equal texts are one node, named by their MD5.
* Order min-hash: every five-word shingle is labelled with its occurrence number.  For each of BANDS permutations the
  TUPLE least labelled shingles are taken and hashed in text order, so that both what is shared and its order count.
* Nodes that agree in a band share a bucket.  A bucket of at most SMALL_BUCKET nodes gives all its pairs.  A larger one
  gives a star: its most central node, the one whose buckets hold most nodes in all, paired with each of the others.
* The links of these pairs make classes.  All nodes of the large buckets that still hold several classes are then joined
  by prefix filtering, which is exact, so every link inside a bucket joins its two classes whatever the bucket's size.
* A pair is a link if an alignment of the two shingle sequences, in order and inside a band, matches m shingles with
  m / (n1 + n2 - m) >= 0.8.  The band is as wide as that threshold allows and so never loses a link; the alignment
  holds the band's bits only.
* Classes are the connected components of the links.

Two texts at the threshold agree in a band with probability 0.8 ** TUPLE or so, and share no bucket with a probability
of (1 - 0.8 ** TUPLE) ** BANDS, some 3 in 100,000; that is the only way to lose a link.

Defined edge cases: a null text counts as empty; empty texts are copies of each other; a text of fewer than five words
is one shingle; repeated rows are copies; a null doc_id never stands for its class unless all are null; an empty table
gives an empty result; other columns are ignored, and kept by `keep_one` whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread_join, spread_joins, table, text_or_empty, written
from .components import components, joined_classes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, TUPLE = 20, 4
SMALL_BUCKET = 4
#: Places of a shingle that the alignment lists one by one; more are one integer.
FEW_PLACES = 16
#: Words whose hashes a worker keeps; beyond it the table starts afresh.
CACHE_WORDS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


_KEYS = _mixed(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * _PRIME)
_XOR, _TIMES = _KEYS[:BANDS, None], _KEYS[BANDS:, None] | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    """One per worker process."""
    return _Hashes()


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the text's shingles, in order."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _PRIME + h[i : n + i]
    return _mixed(out)


def numbered(g: np.ndarray) -> np.ndarray:
    """The shingles labelled by occurrence: the first of a kind keeps its hash, later ones get others."""
    order = np.argsort(g, kind="stable")
    held = g[order]
    first = np.append(True, held[1:] != held[:-1])
    if first.all():
        return g
    at = np.arange(len(g))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(g)
    out[order] = np.where(nth == 0, held, _mixed(held + nth.astype(np.uint64) * _PRIME))
    return out


def sketch(g: np.ndarray) -> list[int]:
    """The order min-hash of each band, from a text's shingles; none for a text without words."""
    if not len(g):
        return []
    g = numbered(g)
    k = min(TUPLE, len(g))
    out = np.zeros(BANDS, np.uint64)
    step = max(1, 1_000_000 // len(g))
    for j in range(0, BANDS, step):
        ranked = (g ^ _XOR[j : j + step]) * _TIMES[j : j + step]
        least = np.sort(np.argpartition(ranked, k - 1, axis=1)[:, :k] if k < len(g) else np.broadcast_to(np.arange(k), (len(ranked), k)), axis=1)
        for i in range(k):
            out[j : j + step] = _mixed(out[j : j + step] * _PRIME + g[least[:, i]])
    return out.view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles matched by the best in-order alignment inside the band that SIMILARITY allows; 0 if too few for a link."""
    n, m = len(a), len(b)
    need = SIMILARITY / (1 + SIMILARITY) * (n + m)
    if min(n, m) < need:
        return 0
    head = int(np.argmin(np.append(a[: min(n, m)] == b[: min(n, m)], False)))
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    tail = int(np.argmin(np.append((a[len(a) - short :] == b[len(b) - short :])[::-1], False))) if short else 0
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    same = head + tail
    if not a or not b:
        return same
    if same + sum((Counter(a) & Counter(b)).values()) < need:
        return 0
    # the bit-parallel longest common subsequence, kept to the band: bit k of v stands for b[low + k], and is cleared
    # where the length grows.  Bits below the band can change no more and are counted as they leave it.
    width = int(n + m - 2 * need) + 1  # what an alignment that reaches the threshold may shift
    places: dict[int, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    dense = {x: sum(1 << j for j in at) if len(b) < 4096 else _bits(at) for x, at in places.items() if len(at) > FEW_PLACES}
    size = 2 * width + 1
    full = (1 << size) - 1
    v, cleared = full, 0
    for i, x in enumerate(a):
        low = i - width
        if i:
            cleared += 1 - (v & 1)
            v = v >> 1 | 1 << size - 1
        at = places.get(x)
        if at is None:
            continue
        if x in dense:
            hit = (dense[x] >> low if low > 0 else dense[x] << -low) & full
        else:
            hit = 0
            for j in at[bisect_left(at, low) :]:
                if j > i + width:
                    break
                hit |= 1 << j - low
        if u := v & hit:
            v = ((v + u) | (v - u)) & full
    return same + cleared + size - v.bit_count()


def _bits(places: list[int]) -> int:
    out = np.zeros(places[-1] // 8 + 1, np.uint8)
    at = np.array(places)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return int.from_bytes(out.tobytes(), "little")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    m = aligned(a, b)
    return m > 0 and m >= SIMILARITY * (len(a) + len(b) - m) - 1e-9


def text_key() -> Column:
    return F.unhex(F.md5(text_or_empty()))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, bands, shingles (32-bit, as bytes) of every row, in one pass over the texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id"), batch.column("key"), pa.array(map(len, found), pa.int32()),
                pa.array(map(sketch, found), pa.list_(pa.int64())), pa.array([g.astype(np.uint32).tobytes() for g in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "bands", "shingles"])

    rows = docs.select("doc_id", text_key().alias("key"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, key binary, n int, bands array<long>, shingles binary")


def verified(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links.  A bucket's pairs share its central node, whose pairs are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()] for c in ("data_a", "data_b")]
            yield batch.select(["a", "b"]).filter(pa.array(map(similar, *sides), pa.bool_()))

    side = lambda c: data.select(F.col("key").alias(c), F.col("shingles").alias(f"data_{c}"))
    rows = spread_joins(written(pairs, "pairs"), [(side("b"), "b"), (side("a"), "a")])
    return rows.select("a", "b", "data_a", "data_b").mapInArrow(run, "a binary, b binary")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _long_enough(x: Column, y: Column) -> Column:
    """Whether two numbers of shingles leave room for a link."""
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-6


def find_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) enough to make the classes of all links inside buckets, and those classes; rows: sketches(docs)."""
    texts = written(rows.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    held = texts.select("key", "n", F.posexplode("bands").alias("band", "hash")).select("key", "n", F.xxhash64("band", "hash").alias("bucket"))
    sizes = held.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(spread_join(written(held, "held"), sizes, "bucket"), "members")
    central = members.groupBy("key").agg(F.sum("size").alias("central"))
    members = written(members.join(central, "key"), "central")
    data = rows.select("key", "shingles").join(central.select("key"), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))
    data = written(data, "shingles")

    # small buckets: all pairs, at most SMALL_BUCKET * (SMALL_BUCKET - 1) / 2 of each
    node = F.struct("key", "n")
    small = members.where(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(node)).alias("x"))
    pairs = small.select(F.explode(F.flatten(F.transform("x", lambda x, i: F.transform(F.slice("x", i + 2, F.lit(SMALL_BUCKET)), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p")).select("p.x", "p.y")
    large = members.where(F.col("size") > SMALL_BUCKET)
    pivots = large.groupBy("bucket").agg(F.max(F.struct("central", "key", "n")).alias("p")).select("bucket", F.struct("p.key", "p.n").alias("y"))
    pairs = pairs.union(spread_join(large, pivots, "bucket").select(node.alias("x"), "y")).where((F.col("x.key") != F.col("y.key")) & _long_enough(F.col("x.n"), F.col("y.n")))
    links = written(verified(pairs.select(*_ordered("x.key", "y.key")).distinct(), data), "links")
    labels = components(links)

    classed = large.select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("class"))
    classed = written(classed, "classed")
    mixed = classed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    rest = classed.join(mixed.select("bucket"), "bucket", "left_semi").groupBy("key").agg(F.first("class").alias("class"))
    more = written(verified(_remaining(rest, data).distinct(), data), "more")
    return links.unionByName(more), joined_classes(labels, more)


def _remaining(rows: DataFrame, data: DataFrame) -> DataFrame:
    """Every pair of nodes of different classes that may be a link; rows: key, class, of all nodes in buckets of several.

    Nothing is lost: shingles numbered by occurrence are sets, a link's sets have a Jaccard index of SIMILARITY or more,
    and such sets share a shingle among the rarest n - ceil(SIMILARITY * n) + 1 of each, for any one order of all.
    The rarest first, what many texts share makes no pairs.  A link's first common shingle leaves enough behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "shingles"):
                held = [numbered(np.frombuffer(x, np.uint32).astype(np.uint64)).view(np.int64) for x in part.column("shingles").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("class"), pa.array(held, pa.list_(pa.int64()))], names=["key", "class", "tokens"])

    sets = rows.join(data, "key").select("key", "class", "shingles").mapInArrow(run, "key binary, class binary, tokens array<long>")
    held = written(sets.select("key", "class", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "tokens")
    often = held.groupBy("token").agg(F.count("*").alias("times"))
    ranked = held.join(often.where("times > 1"), "token", "left").select("key", "class", "n", "token", F.coalesce("times", F.lit(1)).alias("times"))
    ranked = ranked.groupBy("key").agg(F.first("class").alias("class"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "token"))).alias("tokens"))
    # the small amount keeps ceil() from adding one to a whole product
    head = F.slice("tokens", F.lit(1), F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-6).cast("int") + 1)
    posts = written(ranked.select("key", "class", "n", F.posexplode(head).alias("at", "t")).where("t.times > 1").select("key", "class", (F.col("n") - F.col("at")).alias("left"), "n", "t.token"), "posts")
    mains = posts.groupBy("token", "class").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.count("*").alias("classes"))
    posts = written(posts.join(mains.where("classes > 1").select("token", "main"), "token"), "posts")
    # those outside a shingle's largest class, with all; so a class costs work by its size, not by the square of it
    # texts of a link differ in length by SIMILARITY at most, so their bands of length are the same or next to each other
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(SIMILARITY))
    x = posts.where(F.col("class") != F.col("main")).drop("main").withColumn("band", band).alias("x")
    y = posts.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("y")
    once = (F.col("y.class") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))
    enough = F.least("x.left", "y.left") >= SIMILARITY / (1 + SIMILARITY) * (F.col("x.n") + F.col("y.n")) - 1e-6
    fits = _long_enough(F.col("x.n"), F.col("y.n")) & enough
    return x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.class") != F.col("y.class")) & once & fits).select(*_ordered("x.key", "y.key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id (least doc_id of the class), links_found, kept, for every row of docs.

    links_found counts the links that were verified to join the classes; pairs inside a class are not all compared.
    kept marks the row that stays; where rows repeat in doc_id and text it marks each of them.
    """
    rows = written(sketches(docs), "sketches")
    links, labels = find_links(rows)
    degree = links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("links_found"))
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    texts = texts.join(labels.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
    texts = written(texts.select("key", F.coalesce("label", "key").alias("label"), "least", F.coalesce("links_found", F.lit(0).cast("long")).alias("links_found")), "classes")
    # the representative: least doc_id, then least key, for texts that share a doc_id
    heads = texts.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("head"))
    classes = spread_join(texts, heads, "label").select("key", "links_found", F.col("head.least").alias("class_id"), (F.col("key") == F.col("head.key")).alias("first"))
    out = spread_join(rows.select("doc_id", "key"), written(classes, "classes"), "key")
    return out.select("doc_id", "key", "class_id", "links_found", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of docs."""
    found = written(near_duplicates(docs).where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("times")), "kept")
    # the columns of docs travel in a struct, so that no name of theirs can clash
    rows = docs.select(F.col("doc_id"), text_key().alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = rows.alias("r").join(found.alias("f"), (F.col("r.key") == F.col("f.key")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")))
    kept = kept.select("r.doc_id", "r.key", "r.row", "f.times")
    once = kept.where("times = 1").select("row.*")
    again = kept.where("times > 1").dropDuplicates(["doc_id", "key"]).select("row.*")
    return once.unionByName(again)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")
