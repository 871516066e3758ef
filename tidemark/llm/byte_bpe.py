"""Byte-level BPE by Spark's higher-order functions, and decoding.

Documents are split into pre-tokens by the splitter's automaton.  A task passes each distinct word once, as a row of its own
before the documents that hold it, and a document as the numbers of its words.  Spark folds the ranked merges over each
word.  The state is an array of the word's pieces between two ends.  An entry holds, from its high bits, the rank at which its
piece merges with the next one, its place in the array and the piece.  So the least entry is the merge that comes next (the
leftmost of equals) and tells where it is; a step leaves out the entry behind it, puts the merged piece in its place and
looks up only the two ranks that are new.  Two bytes that merge whatever the order are one piece from the start.  The ranks
are one literal: a perfect hash table of pairs of pieces, as a plain Spark map would be searched from end to end.  The same task then puts the documents together from their words' ids, and they
are decoded by concatenating the pieces of those ids.  Nothing is shuffled or broadcast that grows with the data, and rows
stay small.

Steps are interpreted, so their form decides the cost: short states, a filter and a transform by place (slice and concat go
through Scala collections), and values named by the last lambda of an aggregate, as transform copies what it gives.

A fold copies its state with every merge, so a word of over LONG_WORD bytes (a run of letters without a blank) is folded in
blocks of BLOCK bytes, each a word of its own.  Blocks are joined where a document is put together: a sequence of pieces is the
encoding of its bytes if every two neighbours are that of theirs, so it is enough to encode the pieces on both sides of a
seam anew, and as many of them that the outermost new pieces fit their neighbours.

Defined edge cases: a null text counts as empty and has no tokens; a word of any length is encoded whole; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty
from .token_counts import word_starts

#: Bytes of text that are split at once; distinct words that a task numbers before it starts afresh.
SPLIT_BYTES, NUMBERED_WORDS = 2 << 20, 600_000
#: Bytes of a word from which it is folded in blocks, bytes of a block, and pieces on each side of a seam that are encoded anew at first.
LONG_WORD, BLOCK, SEAM = 256, 128, 4
#: An entry's bits: the piece is below PLACE, the entry's place below RANK, the rank above; no merge.
PLACE, RANK = 1 << 17, 1 << 32
NONE = (1 << 20) * RANK


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """left, right, rank of every pair of pieces that together are a piece, which is named by that rank."""
    for piece, rank in ranks.items():
        for at in range(1, len(piece)):
            left, right = ranks.get(piece[:at]), ranks.get(piece[at:])
            if left is not None and right is not None:
                yield left, right, rank


@lru_cache(maxsize=2)
def rank_table(path: str) -> tuple[list[int], list[int], int]:
    """A perfect hash table of the pairs: each group's displacement, in each slot rank * RANK + key or -1, and the keys' factor.

    A pair's key is left * factor + right, its group the key's rest by the number of groups (odd), its slot the key's low bits
    XOR the group's displacement.  The factor is the first by which no two pairs of a group share these bits; groups are placed
    largest first.
    """
    ranks = read_ranks(path)
    left, right, rank = np.array(list(merges(ranks)), np.int64).reshape(-1, 3).T
    slots, groups = 1 << (2 * len(rank)).bit_length(), len(rank) // 3 | 1
    first = (len(ranks) + 1) | 1  # also tells the end, which is numbered len(ranks), from any piece
    for factor in range(first, RANK // (len(ranks) + 1), 2):
        keys = left * factor + right
        group, low = keys % groups, keys & (slots - 1)
        if len(np.unique(group * slots + low)) == len(keys):
            break
    else:
        raise ValueError("no factor tells the pairs apart")
    size = np.bincount(group, minlength=groups)
    order = np.lexsort((group, -size[group]))
    displaced, held, begin = [0] * groups, [-1] * slots, 0
    while begin < len(order):
        members = order[begin : begin + size[group[order[begin]]]]
        at = low[members].tolist()
        d = next((d for d in range(slots) if all(held[i ^ d] < 0 for i in at)), None)
        if d is None:
            raise ValueError("no perfect hash table was found")
        displaced[int(group[members[0]])] = d
        for i, entry in zip(at, (rank[members] * RANK + keys[members]).tolist()):
            held[i ^ d] = entry
        begin += len(members)
    return displaced, held, factor


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, and neither copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def merged(state: Column, path: str) -> Column:
    """A word's state, merged as far as the ranks go."""
    displaced, held, factor = rank_table(path)
    literal = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")
    long = lambda n: F.lit(n).cast("long")
    moves, entries = literal(displaced), literal(held)
    piece = lambda entry: entry.bitwiseAND(long(PLACE - 1))

    def ranked(left: Column, right: Column, low: Column) -> Column:
        """The entry with these bits below its rank, which is that of both pieces."""

        def found(key: Column) -> Column:
            slot = F.get(moves, (key % len(displaced)).cast("int")).bitwiseXOR(key).bitwiseAND(long(len(held) - 1))
            # nothing is left of the key where it is the slot's
            return let(F.get(entries, slot.cast("int")).bitwiseXOR(key), lambda e: F.when(e.bitwiseAND(long(RANK - 1)) == 0, e).otherwise(long(NONE)).bitwiseOR(low))

        return let(left * long(factor) + right, found)

    def merge(s: Column, m: Column) -> Column:
        def at(k: Column, t: Column) -> Column:
            new = ranked(t, piece(F.get(s, k + 2)), m.bitwiseAND(long(RANK - PLACE)).bitwiseOR(t))
            before = lambda x: let(x.bitwiseAND(long(RANK - 1)), lambda low: ranked(piece(low), t, low))
            kept = F.filter(s, lambda _, i: i != k + 1)
            return F.transform(kept, lambda x, i: F.when(i < k - 1, x).when(i > k, x - long(PLACE)).when(i == k, new).otherwise(before(x)))

        place = F.shiftright(m.bitwiseAND(long(RANK - 1)), PLACE.bit_length() - 1).cast("int")
        return let(place, lambda k: let(F.shiftright(m, RANK.bit_length() - 1), lambda t: at(k, t)))

    step = lambda s, _: let(F.array_min(s), lambda m: F.when(m < long(NONE), merge(s, m)).otherwise(s))
    # n pieces have n + 2 entries, and at most n - 1 merges
    return F.when(state.isNotNull(), F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(state) - 2, F.lit(2))), state, step))


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> tuple[np.ndarray, ...]:
    """Of two bytes, the rank, the least rank of pieces that begin with them and that end in them, and whether they merge before any merge of their piece; keys of all pairs in order and their ranks."""
    ranks = read_ranks(path)
    rank, begins, ends = (np.full((256, 256), NONE // RANK, np.int64) for _ in range(3))
    for piece, r in ranks.items():
        if len(piece) == 2:
            rank[piece[0], piece[1]] = r
        if len(piece) > 1:
            begins[piece[0], piece[1]] = min(begins[piece[0], piece[1]], r)
            ends[piece[-2], piece[-1]] = min(ends[piece[-2], piece[-1]], r)
    left, right, made = np.array(list(merges(ranks)), np.int64).reshape(-1, 3).T
    later = np.full(len(ranks) + 1, NONE // RANK, np.int64)
    np.minimum.at(later, left, made)
    np.minimum.at(later, right, made)
    keys = left * PLACE + right
    order = np.argsort(keys)
    first = (rank < NONE // RANK) & (rank < later[np.minimum(rank, len(ranks))])
    return rank, begins, ends, first, keys[order], made[order]


def states(words: pa.Array, path: str) -> pa.ListArray:
    """Of each word, the state from which its merges are folded.

    Two bytes are one piece from the start where no order of merges could part them: their rank is below that of any piece that
    ends in the byte before and the first, or begins with the second and the byte behind, and below that of whatever their piece
    may become part of.  So until they merge nothing touches them, and merging them at once changes no other choice.
    """
    ranks = read_ranks(path)
    pair, begins, ends_in, first, keys, made = byte_pairs(path)
    end = len(ranks)
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    starts = np.zeros(len(raw) + 1, bool)  # where words begin
    starts[offsets[:-1] - offsets[0]] = True
    starts[-1] = True
    a, b = raw[:-1], raw[1:]
    rank = pair[a, b]
    sure = first[a, b] & ~starts[1:-1]
    sure[1:] &= starts[1:-2] | (rank[1:] < ends_in[a[:-1], b[:-1]])
    sure[:-1] &= starts[2:-1] | (rank[:-1] < begins[a[1:], b[1:]])
    piece = of_byte[raw]
    piece[:-1][sure] = rank[sure]
    kept = np.append(True, ~sure)[: len(raw)]
    before = np.append(0, np.cumsum(kept))  # kept pieces before a byte
    n = np.diff(before[offsets - offsets[0]])
    piece, opens = piece[kept], starts[:-1][kept]
    ends = np.cumsum(n + 2)
    out = np.full(int(ends[-1]) if len(ends) else 0, NONE + end, np.int64)
    out[ends - 1] += (n + 1) * PLACE
    place = 1 + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    key = piece[:-1] * PLACE + piece[1:]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    merge = np.full(len(piece), NONE, np.int64)
    merge[:-1] = np.where(~opens[1:] & (keys[at] == key), made[at] * RANK, NONE)
    out[np.repeat(ends - n - 2, n) + place] = merge + place * PLACE + piece
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts in order, and how many each text has."""
    joined, starts = word_starts(texts)
    raw = joined.encode("utf-8", "surrogatepass")
    if len(raw) > len(joined):
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))[starts]
    # every text is followed by a mark, which is no word of it
    ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]) - 1
    marks = np.searchsorted(starts, ends)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
    held = np.ones(len(starts), bool)
    held[marks] = False
    return words.filter(pa.array(held)), np.diff(np.append(-1, marks)) - 1


def in_blocks(words: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
    """The words with long ones as their blocks, how many each text then has, and which are followed by a block of the same word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    size = np.diff(offsets)
    if not len(size) or size.max() <= LONG_WORD:
        return words, counts, None
    n = np.where(size > LONG_WORD, -(-size // BLOCK), 1)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(offsets[:-1], n) + BLOCK * nth
    cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int32)), words.buffers()[2]])
    before = np.append(0, np.cumsum(n))
    ends = np.cumsum(counts)
    return cut, before[ends] - before[ends - counts], np.append(nth[1:] > 0, False)


def numbered_words(docs: DataFrame, path: str) -> DataFrame:
    """Rows of words and rows of documents, in the order in which they must be read.

    era counts the times that numbering started afresh; word is a new word's state, in the order of their numbers;
    doc_id, part are a document and the numbers of its words, inverted where a block of the same word follows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, era = ["era", "word", "doc_id", "part"], 0
        numbers: dict[bytes, int] = {}
        for batch in slices(batches, most=SPLIT_BYTES):
            found, counts, joint = in_blocks(*split_words(batch.column("text").to_pylist()))
            coded = found.dictionary_encode()
            if len(numbers) + len(coded.dictionary) > NUMBERED_WORDS:
                numbers, era = {}, era + 1
            known = len(numbers)
            place = np.array([numbers.setdefault(w, len(numbers)) for w in coded.dictionary.to_pylist()], np.int32)
            new = states(coded.dictionary.filter(pa.array(place >= known)), path)
            for k in range(0, len(new), 10_000):
                part = new.slice(k, 10_000)
                none = [pa.nulls(len(part), batch.schema.field("doc_id").type), pa.nulls(len(part), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), era, np.int32)), part, *none], names=names)
            held = place[coded.indices.to_numpy(zero_copy_only=False)]
            parts = np.split(held if joint is None else np.where(joint, ~held, held), np.cumsum(counts)[:-1])
            held = [pa.array(np.full(len(batch), era, np.int32)), pa.nulls(len(batch), new.type), batch.column("doc_id"), pa.array([x.tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(held, names=names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"era int, word array<bigint>, doc_id {id_type}, part binary")


class Ids:
    """The ids of the words numbered so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.end, self.flat, self.stops = len(ranks), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.ranks, self.pieces, self.fits = ranks, {r: p for p, r in ranks.items()}, {}

    def add(self, words: pa.ListArray) -> None:
        flat = words.flatten().to_numpy(zero_copy_only=False) & (PLACE - 1)
        piece = flat < self.end
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        self.stops = np.append(self.stops, self.stops[-1] + np.append(0, np.cumsum(piece))[offsets[1:]])
        self.flat = np.append(self.flat, flat[piece].astype("<u4"))

    def of(self, part: bytes) -> np.ndarray:
        at = np.frombuffer(part, np.int32)
        joint = at < 0
        if not joint.any():
            return self._of(at)
        at = np.where(joint, ~at, at)
        ends = np.flatnonzero(~joint)  # of words
        starts = np.append(0, ends[:-1] + 1)
        out, done = [], 0
        for a, b in zip(starts[ends > starts].tolist(), ends[ends > starts].tolist()):
            out += [self._of(at[done:a]), self._joined(at[a : b + 1])]
            done = b + 1
        return np.concatenate([*out, self._of(at[done:])])

    def _of(self, at: np.ndarray) -> np.ndarray:
        n = self.stops[at + 1] - self.stops[at]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.stops[at] - ends + n, n)]

    def _joined(self, blocks: np.ndarray) -> np.ndarray:
        """The ids of a word, from those of its blocks."""
        out: list[int] = []
        for k in blocks.tolist():
            new = self.flat[self.stops[k] : self.stops[k + 1]].tolist()
            wide = SEAM
            while out:
                left, right = out[-wide:], new[:wide]
                seam = self.encoded(b"".join(self.pieces[i] for i in left + right))
                rest, after = out[: len(out) - len(left)], new[len(right) :]
                if (not rest or self.fit(rest[-1], seam[0])) and (not after or self.fit(seam[-1], after[0])):
                    del out[len(rest) :]
                    new = seam + after
                    break
                wide *= 2
            out += new
        return np.array(out, "<u4")

    def fit(self, a: int, b: int) -> bool:
        """Whether two pieces stay apart side by side."""
        if (a, b) not in self.fits:
            if len(self.fits) >= NUMBERED_WORDS:
                self.fits.clear()
            self.fits[a, b] = self.encoded(self.pieces[a] + self.pieces[b]) == [a, b]
        return self.fits[a, b]

    def encoded(self, raw: bytes) -> list[int]:
        """The ids of a few bytes, by a heap of the merges that may come next."""
        n, ranks = len(raw), self.ranks
        stop = list(range(1, n + 1))  # by the start of a piece, where it ends; 0 once it is no start
        prior = list(range(-1, n - 1))
        heap = [(ranks[raw[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = stop[i]
            if j < n and raw[i : stop[j]] in ranks:
                heapq.heappush(heap, (ranks[raw[i : stop[j]]], i, j, stop[j]))

        while heap:
            _, i, j, k = heapq.heappop(heap)
            if stop[i] == j and stop[j] == k:
                stop[i], stop[j] = k, 0
                if k < n:
                    prior[k] = i
                offer(i)
                if prior[i] >= 0:
                    offer(prior[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : stop[i]]])
            i = stop[i]
        return out


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_bytes (little-endian unsigned 32-bit) of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        era, ids = -1, None
        for batch in batches:
            eras = batch.column("era").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(eras)) + 1).tolist(), len(eras)]
            for rows in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                if rows.column("era")[0].as_py() != era:
                    era, ids = rows.column("era")[0].as_py(), Ids(read_ranks(ranks_path))
                ids.add(rows.column("word").drop_null())
                rows = rows.filter(rows.column("part").is_valid())
                for part in (rows.slice(k, 500) for k in range(0, len(rows), 500)):
                    out = [ids.of(x) for x in part.column("part").to_pylist()]
                    n = [len(x) for x in out]
                    held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(out).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), held, pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "n_tokens", "ids", "ids_bytes"])

    rows = numbered_words(docs, ranks_path).withColumn("word", merged(F.col("word"), ranks_path))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids array<int>, ids_bytes binary")


def decoded(ids: Column, ranks_path: str) -> Column:
    """The bytes that an array of ids stands for: their pieces, one behind the other.

    Pieces are written as the characters U+0000 to U+00FF, as Spark joins arrays of strings only.
    """
    pieces = sorted((rank, piece.decode("latin-1")) for piece, rank in read_ranks(ranks_path).items())
    held = F.from_json(F.lit(json.dumps([p for _, p in pieces])), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(held, i)), ""), "ISO-8859-1")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = encode(table(spark, sf_dir, "documents"), ranks)
    return rows.select("doc_id", "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"))
