"""Embedding near-duplicates, phrases and the prefix trie against plain code on small tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import embeddings, phrases, prefix_trie
from tidemark.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def linked(rows):
    """vec_id or place -> links, least id of its component, by all pairs; a null id is told apart by its place."""
    units = []
    for _, label, v in rows:
        fine = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if fine else None
        units.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= embeddings.COSINE:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return collections.Counter((k, links[i], least.get(find(i)), k is not None and k == least.get(find(i))) for i, (k, _, _) in enumerate(rows))


def near(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, key string, row int").repartition(3)
    out = embeddings.near_vectors(table)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return collections.Counter(map(tuple, out.collect()))


def test_vectors_that_link_with_nothing(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, math.nan], [math.inf, 1.0]]
    rows = [(i, 1, v) for i, v in enumerate(odd)] + [(10, None, [1.0, 0.0]), (11, None, [1.0, 0.0])]
    rows += [(20, 1, [1.0, 0.0]), (20, 1, [1.0, 0.0]), (21, 2, [1.0, 0.0]), (22, 1, [1.0, 0.0, 0.0]), (None, 1, [1e300, 1e297]), (None, 3, [1e-300, 0.0])]
    assert near(spark, rows) == linked(rows)
    assert near(spark, [r for r in rows if r[0] is None]) == linked([r for r in rows if r[0] is None])


def test_no_vectors(spark):
    assert not near(spark, [])


def test_groups_of_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, (size, spread) in enumerate([(150, 0.02), (60, 0.0), (80, 0.9), (40, 0.35), (2, 0.1)]):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((len(rows), g % 2, (centre + spread / 32**0.5 * rng.standard_normal(32)).tolist()))
    rows += [(len(rows) + i, 0, rng.standard_normal(32).tolist()) for i in range(200)]
    want, got = linked(rows), near(spark, rows)
    links = lambda c: sum(r[1] * n for r, n in c.items())
    assert links(want) >= links(got) >= 0.97 * links(want)
    assert sum((want & got).values()) >= 0.9 * len(rows)


def test_tables_of_a_recall():
    for k in (0, 5, 12, 20):
        n, q = embeddings.tables_for(k), embeddings.collision_chance(k)
        missed = lambda n: (1 - q) ** n + n * q * (1 - q) ** (n - 1)  # noqa: B023, E731
        assert missed(n) <= 1 - embeddings.RECALL < missed(n - 1)


def test_exact_counts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    members = spark.createDataFrame([(i, i % 2, bytearray(v.tobytes())) for i, v in enumerate(x)], "row long, ball long, unit binary")
    pairs = spark.createDataFrame([(0, 1, 20, 20)], "a long, b long, size_a long, size_b long")
    got = collections.Counter()
    for r in embeddings.counted(pairs, members).collect():
        got[r.row] += r.n
    near_by = (x @ x.T >= embeddings.COSINE) & (np.arange(40)[:, None] % 2 != np.arange(40) % 2)
    assert got == {i: int(n) for i, n in enumerate(near_by.sum(1)) if n}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, top):
    found, out = collections.defaultdict(collections.Counter), []
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    found[lang or "und"][tuple(words[i : i + k])] += 1
    for lang, f in found.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        asked = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in asked.items():
            longer = [v for q, v in asked.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * v >= 80 * a for v in longer):
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(spark, rows, top):
    table = spark.createDataFrame([(*r, "y", 3) for r in rows], "lang string, text string, word string, n int").repartition(4)
    out = phrases.mined(table, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def test_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST", 3)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
    rng = np.random.default_rng(2)
    words = ["a", "b", "B", "ñandú", "日本", "c\x1c", "d\x00", "Ed"]
    rows = [(["en", "fr", None, "und"][k % 4], "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", "\t ", ". ", "\n", ",", "  "])) for _ in range(rng.integers(0, 60)))) for k in range(60)]
    rows += [("en", None), ("xx", ""), ("yy", " .,; "), ("en", "same words here again " * 200), ("en", "a " * 500), rows[0], rows[0]]
    for top in (2000, 7):
        assert mined(spark, rows, top) == plain_phrases(rows, 3, top)


def test_no_phrases(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [("en", None), (None, "one two")], 10) == []


def test_phrases_when_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 15)  # many phrases in one place of the filter change nothing
    rows = [("en", f"x{i % 40} y{i % 40} z{i % 20}") for i in range(2000)]
    assert mined(spark, rows, 100) == plain_phrases(rows, 30, 100)


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)} {role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    nodes, made = collections.defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = own.get(first, [])[:h] + own[c][h:]
        for d in range(len(made[c]) + 1):
            nodes[tuple(made[c][:d])].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        childless = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else -1, len(members), sum(len(q) == len(p) + 1 for q in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_trie(spark, blocks):
    rng = np.random.default_rng(blocks)
    rows = [(int(c), None if k == 0 and c % 7 == 0 else int(k), ["user", "assistant", None][k % 3], ["hi", None, "", "日本", "more text"][rng.integers(0, 5)]) for c in range(0, 230) for k in range(rng.integers(1, 5))]
    rows += [(c, 1, "user", f"tie {x}") for c in (300, 301) for x in (2, 1, 1)]
    rows += [(-5, k, "user", "x") for k in range(9)] + [(405, 0, "a", "gone"), (None, 0, "user", "nobody"), rows[0], rows[0]]
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(60) for t in range(3)] + [(7, 10 + k, "user", str(k)) for k in range(300)]
    table = spark.createDataFrame([(*r, b"x", 5) for r in rows], "conv_id long, turn long, role string, text string, path binary, n int").repartition(5)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.trie_of(table, blocks).select(*TRIE).collect())
    assert got == plain_trie(rows)


def test_empty_trie(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie_of(table).collect() == []


@pytest.mark.parametrize("name, source", [("op12_phrases", "documents"), ("op13_prefix_trie", "conversations")])
def test_oracles(spark, name, source):
    con = duckdb.connect()
    con.execute(f"create view {source} as select * from read_parquet('{DATA}/{source}.parquet')")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA).select(*names).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
