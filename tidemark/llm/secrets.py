"""Secret scans by one combined deterministic automaton.

Every rule is a regular expression over bytes.  It becomes a machine with leftmost, non-overlapping, longest matching
built in: its states list the live starts in order, a match shuts out later starts, and when the match cannot go on the
machine says so and begins afresh at that very byte.  The product of all machines is built by subset construction over
byte classes, minimised by partition refinement, and laid out as transition arrays.  A text is read once, byte by
byte; where an array says that a rule's match has ended, the reversed rule is walked backwards to its start.

Rules whose match could be overtaken by a later start, or could pass a non-accepting state after its first acceptance,
are refused when they are compiled, as the machine could not stay deterministic about their ends.

Defined edge cases: a null text counts as empty and has no spans; repeated rows each give a row; an empty table gives
an empty result; other columns are ignored by `scan_secrets` and kept by `redact_secrets`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int = 1  # bytes of a match; shorter ones are dropped without another try
    group_least: int = 0  # the same for group 2
    tail: str = ""  # what of the text behind a match belongs to it


BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*", 24),
)
#: Rules whose matches run on freely multiply the product's states, so keys with a telling prefix are one rule.
MORE_RULES = (
    Rule("key", r"(gh[pousr]_|glpat-|npm_|AIza|xox[abprs]-|[sr]k_live_)[A-Za-z0-9_-]+", 24),
    # the key itself and its last line, the header lines of an encrypted one first
    Rule(
        "pem", r"-----BEGIN\x20(RSA\x20|EC\x20|OPENSSH\x20)?PRIVATE\x20KEY-----",
        tail=r"(?:[\r\n]++(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:[\x20\t\r\n]*+[A-Za-z0-9+/]{16,}+=*+)*+(?:[\x20\t\r\n]*+[A-Za-z0-9+/]++=*+(?=[\x20\t\r\n]*+-----END))?+(?:[\x20\t\r\n]*+-----END\x20(?:RSA\x20|EC\x20|OPENSSH\x20)?PRIVATE\x20KEY-----)?+",
    ),
)
#: A byte that no UTF-8 text holds; it ends every match.
END = 0xFF


class Machine:
    """One rule: a byte automaton with empty moves, forwards and backwards."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        self.first = self._state()
        self.last = self._build(sre_parser.parse(rule.pattern), self.first, False)
        self.back_moves: list[list[tuple[frozenset, int]]] = [[] for _ in self.moves]
        self.back_empty: list[list[int]] = [[] for _ in self.moves]
        for s, out in enumerate(self.moves):
            for on, t in out:
                self.back_moves[t].append((on, s))
        for s, out in enumerate(self.empty):
            for t in out:
                self.back_empty[t].append(s)
        self.start = self._closed({self.first}, self.empty)
        self.back_start = self._closed({self.last}, self.back_empty)
        self.back_seen: dict[tuple[frozenset, int], frozenset] = {}
        self.exact = re.compile(rule.pattern.encode())
        self.tail = re.compile(rule.tail.encode()) if rule.tail else None

    def _state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def _build(self, tree, at: int, fold: bool) -> int:
        """Add a parsed pattern after state `at`; returns its end."""
        for op, arg in tree:
            if op is sre.LITERAL:
                at = self._on({arg}, at, fold)
            elif op is sre.IN:
                at = self._on({c for kind, x in arg for c in ([x] if kind is sre.LITERAL else range(x[0], x[1] + 1))}, at, fold)
            elif op is sre.SUBPATTERN:
                at = self._build(arg[3], at, fold or bool(arg[1] & sre.SRE_FLAG_IGNORECASE))
            elif op is sre.BRANCH:
                end = self._state()
                for branch in arg[1]:
                    self.empty[self._build(branch, at, fold)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self._build(body, at, fold)
                if most is sre.MAXREPEAT:
                    loop = self._state()
                    self.empty[at].append(loop)
                    self.empty[self._build(body, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self._state()
                    self.empty[at].append(end)
                    for _ in range(most - least):
                        at = self._build(body, at, fold)
                        self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"{self.rule.kind}: {op} is not supported")
        return at

    def _on(self, chars: set[int], at: int, fold: bool) -> int:
        if fold:
            chars = {y for c in chars for y in (ord(chr(c).lower()), ord(chr(c).upper()))}
        to = self._state()
        self.moves[at].append((frozenset(chars), to))
        return to

    @staticmethod
    def _closed(states: set[int], empty: list[list[int]]) -> frozenset:
        out, work = set(states), list(states)
        while work:
            for t in empty[work.pop()]:
                if t not in out:
                    out.add(t)
                    work.append(t)
        return frozenset(out)

    def _step(self, states: frozenset, byte: int) -> frozenset:
        return self._closed({t for s in states for on, t in self.moves[s] if byte in on}, self.empty)

    def next(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """State after a byte, and whether a match ended before it.  state: (live starts in order, matched)."""
        starts, matched = state
        ended = False
        if matched:
            went = self._step(starts[0], byte)
            if went:
                if self.last not in went:
                    raise ValueError(f"{self.rule.kind}: a match may pass a state that does not accept")
                return ((went,), True), False
            starts, ended = (), True
        out, seen = [], set()
        for states in (*starts, self.start):
            went = self._step(states, byte) - seen
            if went:
                seen |= went
                out.append(went)
        for i, states in enumerate(out):
            if self.last in states:
                if i:
                    raise ValueError(f"{self.rule.kind}: a later start may match first")
                return ((states,), True), ended
        return (tuple(out), False), ended

    def span_start(self, raw: bytes, end: int, floor: int) -> int:
        """The leftmost start, at `floor` or later, of a match that ends at `end`."""
        states, found = self.back_start, end
        for i in range(end - 1, floor - 1, -1):
            key = (states, raw[i])
            if (went := self.back_seen.get(key)) is None:
                went = self.back_seen[key] = self._closed({t for s in states for on, t in self.back_moves[s] if raw[i] in on}, self.back_empty)
            states = went
            if not states:
                break
            if self.first in states:
                found = i
        return found

    def holds(self, piece: bytes) -> bool:
        """Whether a match is long enough to count."""
        if len(piece) < self.rule.least:
            return False
        return not self.rule.group_least or len(self.exact.fullmatch(piece)[2]) >= self.rule.group_least


class Automaton:
    """The minimised product of all rules' machines, as transition arrays that refer to each other."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.machines = [Machine(r) for r in rules]
        classes: dict[tuple, int] = {}
        on = [s for m in self.machines for out in m.moves for s, _ in out]
        of_byte = [classes.setdefault(tuple(b in s for s in on), len(classes)) for b in range(256)]
        sample = [of_byte.index(c) for c in range(len(classes))]
        start = (tuple(((), False) for _ in rules), ())
        index, work, moves = {start: 0}, [start], []
        known: list[dict] = [{} for _ in rules]
        for state, _ in work:
            row = []
            for byte in sample:
                parts, ended = [], []
                for k, (machine, part) in enumerate(zip(self.machines, state)):
                    if (got := known[k].get((part, byte))) is None:
                        got = known[k][part, byte] = machine.next(part, byte)
                    parts.append(got[0])
                    if got[1]:
                        ended.append(k)
                to = (tuple(parts), tuple(ended))
                if to not in index:
                    index[to] = len(index)
                    work.append(to)
                row.append(index[to])
            moves.append(row)
        self.built = len(index)
        table = np.array(moves)
        ends = [ended for _, ended in work]
        kinds = {e: i for i, e in enumerate(dict.fromkeys(ends))}
        group = np.array([kinds[e] for e in ends])
        while True:  # partition refinement
            _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == group.max():
                break
            group = finer
        one = {int(g): i for i, g in enumerate(group)}  # a member of each class
        self.states = len(one)
        rows: dict[int, list] = {g: [] for g in one}
        for g, i in one.items():
            rows[g].extend(rows[int(group[table[i, c]])] for c in of_byte)
            rows[g].append(ends[i])
        self.first = rows[int(group[0])]

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """start, rule, end of every span that counts, in code points, sorted."""
        raw = text.encode("utf-8", "surrogatepass") + bytes([END])
        row, ended = self.first, []
        for i, byte in enumerate(raw):
            row = row[byte]
            if row[256]:
                ended.append((i, row[256]))
        if not ended:
            return []
        floors, spans = [0] * len(self.machines), []
        for end, rules in ended:
            for k in rules:
                machine = self.machines[k]
                start = machine.span_start(raw, end, floors[k])
                floors[k] = end
                if machine.holds(raw[start:end]):
                    spans.append((start, k, machine.tail.match(raw, end, len(raw) - 1).end() if machine.tail else end))
        spans.sort()
        if len(raw) - 1 == len(text):
            return spans
        place, at, n = {}, 0, 0
        for p in sorted({p for s in spans for p in (s[0], s[2])}):
            n += len(raw[at:p].decode("utf-8", "surrogatepass"))
            place[p], at = n, p
        return [(place[a], k, place[b]) for a, k, b in spans]


@lru_cache(maxsize=2)
def automaton(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> Automaton:
    """Compiled once per worker process."""
    return Automaton(rules)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, spans (kind, start, end by start and rule) of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(rules)
        for batch in slices(batches):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in found.scan(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; the columns of docs, n_chars brought up to date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(rules)
        for batch in slices(batches):
            texts = [t and redact(t, found.scan(t)) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def digest(kinds: tuple[str, ...]):
    """The query's columns from spans: counts of the base kinds, their digest, and all spans as a string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(found) - F.size(F.array_remove(found, k))).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", *digest(tuple(r.kind for r in BASE_RULES)))
