"""Token counts by finite-state transducers.

Two deterministic machines stand for the byte-level tokenizer.

* The splitter walks over code points and says where a pre-token begins.  What its pattern looks ahead to is
  put into the input symbols (a sliding window of three), which leaves eight states.  Every symbol is a map of
  these states; the maps they generate under composition are enumerated once, with their multiplication table.
  A batch of texts is cut into chunks; each chunk multiplies up its maps, the chunk maps are composed by a
  parallel prefix scan, and so every position learns its state without a sequential walk over the text.
* The counter reads the bytes of one pre-token.  Its transitions carry the number of tokens that became certain
  with the byte, its states carry the number still to come if the word ended there.  A state holds, for each
  start that may still begin a vocabulary token, the trie node reached, the last token before that start and the
  tokens counted up to it; a token may follow another only if the two alone encode to themselves.  States and
  transitions are determinised on demand and shared by all words; each distinct word is walked once per task.

Defined edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty table
gives an empty result; other columns are ignored.  Texts are never cut: a text of any length only makes more chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty

LIMIT_TOKENS = 512
#: Bounds of what a worker keeps; beyond one of them that table starts afresh.
CACHE_WORDS, CACHE_TRANSITIONS = 800_000, 800_000
CHUNK = 512

# Splitter symbols.  A2/A3: an apostrophe that would begin a contraction of two or three characters; SX/WX: a
# space / other white space before something that is not white space; S/W: before white space or the end.
L, N, O, A2, A3, S, W, SX, WX, END = range(10)
FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, SPACE, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state of the splitter, and whether a pre-token begins at the symbol."""
    if symbol == END:
        return FRESH, True
    if state == ONE_MORE:
        return FRESH, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if symbol in (S, W):
        return BLANKS, state != BLANKS
    if symbol == SX:
        return SPACE, True
    if symbol == WX:
        return FRESH, True
    if symbol in (A2, A3) and state not in (OTHERS, SPACE):
        return (ONE_MORE if symbol == A2 else TWO_MORE), True
    run = {L: LETTERS, N: NUMBERS}.get(symbol, OTHERS)
    return run, state not in (run, SPACE)


@lru_cache(maxsize=1)
def _splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, multiplication table, elements as maps, and the boundary table [state, symbol]."""
    maps = [tuple(_step(s, x)[0] for s in range(8)) for x in range(10)]
    index = {tuple(range(8)): 0}
    work = list(index)
    for m in work:
        for g in maps:
            if (n := tuple(g[x] for x in m)) not in index:
                index[n] = len(index)
                work.append(n)
    elements = np.array(list(index), np.uint8)
    product = np.empty((len(index), len(index)), np.uint16)
    for b, second in enumerate(elements):
        for a, row in enumerate(second[elements]):
            product[a, b] = index[tuple(row.tolist())]
    first = np.array([[_step(s, x)[1] for x in range(10)] for s in range(8)])
    return np.array([index[m] for m in maps], np.uint16), product, elements, first


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """L, N, S, W or O of each code point, as the tokenizer library itself sees them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.full(0x110000, O, np.uint8)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(points)
    place = np.array([ord(c) for c in points])
    for kind, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (W, r"\s+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[place[a:b]] = kind
    table[0x20] = S
    return table


def word_starts(texts: list[str]) -> tuple[str, np.ndarray]:
    """All texts joined by an end mark each, and the position of each pre-token's and each mark's start."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = _classes()[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    blank = (symbols == S) | (symbols == W)
    blank[ends] = True
    before_text = np.append(~blank[1:], False)
    symbols = np.where((symbols == S) & before_text, SX, np.where((symbols == W) & before_text, WX, symbols))
    marks = np.flatnonzero(points[:-1] == 0x27)
    if len(marks):
        after = points[np.minimum(marks[:, None] + (1, 2), len(points) - 1)]
        symbols[marks[np.isin(after[:, 0], [ord(c) for c in "sdmt"])]] = A2
        pair = after[:, 0] * 256 + np.where(after[:, 1] < 256, after[:, 1], 0)
        symbols[marks[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("ll", "ve", "re")])]] = A3
    symbols[ends] = END

    of_symbol, product, elements, first = _splitter()
    rows = -(-len(symbols) // CHUNK)
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[: len(symbols)] = symbols
    step = of_symbol[padded.reshape(rows, CHUNK).T]
    for i in range(1, CHUNK):  # within all chunks at once
        step[i] = product[step[i - 1], step[i]]
    scan = step[-1].copy()  # over the chunks: after round r each map covers 2^r chunks
    d = 1
    while d < rows:
        scan[d:] = product[scan[:-d], scan[d:]]
        d *= 2
    entry = np.append(np.uint8(FRESH), elements[scan[:-1], FRESH])
    states = np.vstack([entry[None, :], elements[step[:-1], entry[None, :]]]).T.reshape(-1)[: len(symbols)]
    return joined, np.flatnonzero(first[states, symbols])


class Counter(dict):
    """Tokens of a pre-token: a dict of those seen, filled by walking the counting transducer."""

    def __init__(self, path: str):
        super().__init__()
        model = json.load(open(path, encoding="utf-8"))["model"]
        shown = _byte_alphabet()
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.of_byte = [model["vocab"][c] for c in shown]
        self.pieces = {i: t for t, i in model["vocab"].items()}
        place = {c: b for b, c in enumerate(shown)}
        # trie over bytes: child of (node, byte), token that ends at a node, whether a node has children
        self.child: dict[int, int] = {}
        self.ends = [-1]
        self.inner = [True]
        for token, i in model["vocab"].items():
            node = 0
            for c in token:
                key = node << 8 | place[c]
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = to
            self.ends[node] = i
        self.fits: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        start = ((0, -1, 0),)
        self.states = {start: 0}
        self.live = [start]
        self.still = [0]
        self.moves: dict[int, int] = {}

    def merged(self, parts: list[str]) -> list[str]:
        """Plain ranked merging; only used on two tokens at a time, to tell which may stand side by side."""
        while len(parts) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, last: int, token: int) -> bool:
        key = (last + 1) << 32 | token
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) >= CACHE_TRANSITIONS:
                self.fits.clear()
            t = self.pieces[token]
            want = [t] if last < 0 else [self.pieces[last], t]
            ok = self.fits[key] = self.merged(list("".join(want))) == want
        return ok

    def _move(self, state: int, byte: int) -> int:
        """Determinise one transition: next state in the high bits, emitted tokens in the low sixteen."""
        live, here = [], None
        for node, last, count in self.live[state]:
            to = self.child.get(node << 8 | byte)
            if to is not None:
                if here is None and self.ends[to] >= 0 and self.may_follow(last, self.ends[to]):
                    here = (0, self.ends[to], count + 1)
                if self.inner[to]:
                    live.append((to, last, count))
        live.append(here)
        base = min(count for _, _, count in live)
        key = tuple((n, t, c - base) for n, t, c in live)
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.live)
            self.live.append(key)
            self.still.append(here[2] - base)
        move = self.moves[state << 8 | byte] = to << 16 | base
        return move

    def __missing__(self, word: str) -> int:
        if len(self.moves) >= CACHE_TRANSITIONS:
            self._restart()
        state = total = 0
        moves = self.moves
        for byte in word.encode("utf-8", "replace"):
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> 16
            total += move & 0xFFFF
        total += self.still[state]
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = total
        return total


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    out, extra = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


@lru_cache(maxsize=1)
def _special_tokens(path: str) -> tuple[str, ...]:
    return tuple(t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"])


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    """One per worker process, which Spark reuses for its next tasks."""
    return Counter(path)


def token_counts(texts: list[str], counter: Counter, special: tuple[str, ...] = ()) -> list[int]:
    """Tokens of each text; a special string counts as one token and parts what stands beside it."""
    parts, of, plus = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        split = [text]
        for s in special:
            if s in text:
                split = [y for x in split for y in x.split(s)]
        plus[i] = len(split) - 1
        parts += split
        of += [i] * len(split)
    if not parts:
        return []
    joined, starts = word_starts(parts)
    bounds = starts.tolist()
    words = map(joined.__getitem__, map(slice, bounds, bounds[1:] + [len(joined)]))
    counts = np.fromiter(map(counter.__getitem__, words), np.int64, len(bounds))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    at = np.searchsorted(starts, ends)
    counts[at] = 0  # the end marks
    total = np.append(0, np.cumsum(counts))
    each = np.diff(np.append(0, total[at]))
    return (np.bincount(np.array(of), each, len(texts)).astype(np.int64) + plus).tolist()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, special = _counter(tokenizer), _special_tokens(tokenizer)
        for batch in slices(batches):
            n = token_counts(batch.column("text").to_pylist(), counter, special)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
