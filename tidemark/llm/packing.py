"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document is encoded, closed with a separator id, and cut into pieces only where it is longer than a
sequence.  Pieces are dealt evenly over groups of bounded size; each group is packed by best-fit decreasing and
its bin count is held against lower bounds from dual-feasible functions.  A group that meets its bound is
certified and done.  Groups with a gap hand the pieces of their emptiest bins to an exchange, which is packed
again, until everything is certified or another exchange no longer saves a bin.

Only (row id, length) pairs travel in the packing rounds; token ids never leave the encoding task.

Defined edge cases: a null text counts as empty and gives one piece of one id; repeated rows and repeated ids are
packed each for itself; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_or_empty, table, written

SEQUENCE_TOKENS = 4096
SEPARATOR_ID = 1
#: Pieces that one group packs; a group is one task's work.
GROUP_PIECES = 20_000
#: Written forms and lower-cased words whose ids a worker keeps; beyond it that table starts afresh.
CACHE_FORMS, CACHE_WORDS = 600_000, 900_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Tokenizer.from_file(path)


class WordIds:
    """Little-endian ids of white-space delimited words, encoded by the library on first sight.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            closes[i] = token.endswith("</w>")
        self.closes = closes
        self.forms: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> None:
        """Ids of many words of letters at once: each is one pre-token and ends with the one token that closes it."""
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            [coded] = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)  # without character places
            ids = np.array(coded.ids, dtype="<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            self.words.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def _learn(self, forms: set[str]) -> None:
        plain, other, alone, new = [], [], set(), set()
        for form in forms:
            core = form.rstrip(".,")
            # letters below U+0130 are one run for the pre-tokenizer, and lower-casing them is one to one
            if core.isalpha() and (core.isascii() or max(core) < "\u0130"):
                tail, low = form[len(core) :], core.lower()
                plain.append((form, low, tail))
                new.add(low)
                alone.add(tail)
            else:
                other.append(form)
        alone.update(other)
        self._encode(list(new.difference(self.words)))
        alone = list(alone.difference(self.words))
        for form, coded in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.words[form] = np.array(coded.ids, dtype="<u4").tobytes()
        self.forms.update((form, self.words[form]) for form in other)
        self.forms.update((form, self.words[low] + self.words[tail]) for form, low, tail in plain)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        missing = set(chain.from_iterable(split)).difference(self.forms)
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words = {"": b""}
        if len(self.forms) + len(missing) > CACHE_FORMS:
            self.forms = {"": b""}
            missing = set(chain.from_iterable(split)).difference(self.forms)
        self._learn(missing)
        return [b"".join(map(self.forms.__getitem__, forms)) for forms in split]


@lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    """One per worker process, which Spark reuses for its next tasks."""
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document, ids encoded inside the task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer), np.array([SEPARATOR_ID], dtype="<u4").tobytes()
        for batch in slices(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(words.encode(batch.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible lower bounds on the number of bins.

    A dual-feasible function f keeps sums of at most one capacity at most one capacity, so ceil(sum f / capacity)
    bounds the bins from below.  Used are the identity, the threshold family of Martello and Toth for every
    threshold, and the rounding family u(k) of Fekete and Schepers for k up to 20.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    best = -(-int(lengths.sum()) // capacity)
    sizes = np.arange(capacity + 1)
    above, mass = np.cumsum(count[::-1])[::-1], np.cumsum(count * sizes)
    half = capacity // 2
    large = int(count[half + 1 :].sum())
    t = np.arange(0, half + 1)
    # over a threshold t: items above capacity - t stand alone; the others above half leave room for items of t or more
    alone = np.where(capacity - t + 1 <= capacity, above[np.minimum(capacity - t + 1, capacity)], 0) * (t > 0)
    big = large - alone
    big_mass = mass[np.maximum(capacity - t, half)] - mass[half]
    small_mass = mass[half] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    need = np.maximum(0, -(-(small_mass - (big * capacity - big_mass)) // capacity))
    best = max(best, int((alone + big + need).max()))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        f = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each item, and the fill of each bin; ties by input order, newest bin of a fit first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room - n:
            open_bins.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _pack_group(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rid", kind="stable")
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        final = np.ones(len(fill), bool)
        if gap > 0:
            final[np.argsort(fill, kind="stable")[: 4 * gap + 4]] = False
        return pd.DataFrame({"rid": group["rid"], "length": lengths, "grp": group["grp"], "bin": bins, "offset": offsets, "final": final[bins], "certified": gap <= 0})

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """rid, sequence_id, offset, certified for rows (rid, length); see the module's account of the method."""
    if group_pieces > 1 << 15:
        raise ValueError("a group's bins are numbered in 15 bits")
    full = pieces.where(F.col("length") >= capacity).select("rid", F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    out, rest, opened, former, k = full, pieces.where(F.col("length") < capacity).select("rid", "length"), None, None, 0
    while n := rest.count():
        groups = -(-n // group_pieces)
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("rid", F.lit(k)), F.lit(groups)))
        packed = written(dealt.groupBy("grp").applyInPandas(_pack_group(capacity), "rid long, length long, grp long, bin long, offset long, final boolean, certified boolean"), f"packed{k}")
        bins = packed.groupBy("grp", "bin").agg(F.first("final").alias("final")).agg(F.count("*").alias("bins"), F.count_if(~F.col("final")).alias("opened")).first()
        # the exchange goes on as long as it saves a bin; a single group has nobody to exchange with
        last = groups == 1 or opened is not None and bins["bins"] >= opened
        # bit 62 and the round keep these apart from the row ids that number the full sequences
        number = F.lit((1 << 62) + (k << 46)) + F.col("grp") * (1 << 15) + F.col("bin")
        places = lambda rows: rows.select("rid", number.alias("sequence_id"), "offset", "certified")  # noqa: B023, E731
        if last:
            # an exchange that lost bins is taken back: its pieces keep the places of the round before
            out = out.unionByName(former if opened is not None and bins["bins"] > opened else places(packed))
            break
        out, former = out.unionByName(places(packed.where("final"))), places(packed.where("not final"))
        rest, opened, k = packed.where("not final").select("rid", "length"), bins["opened"], k + 1
    return out


def best_fit_pack(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified: the packing of all documents."""
    pieces = written(cut_pieces(docs, tokenizer, tokens).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack_pieces(pieces.select("rid", "length"), tokens, group_pieces), "rid").drop("rid")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
