"""The operators against plain versions that compare or count everything, on inputs where a shortened job shows."""

import itertools
import re
from re import _parser

import collections
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers

from tidemark.llm import license_rules, licenses, near_duplicates, quality_rules


def brute_classes(texts: dict[int, str]) -> dict[int, int]:
    """The least id of each text's class, from all pairs."""
    sets = {i: near_duplicates.shingles(t).astype(np.uint32) for i, t in texts.items()}
    head = {i: i for i in texts}

    def find(i: int) -> int:
        while head[i] != i:
            i = head[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        if near_duplicates.similar(sets[i], sets[j]):
            a, b = find(i), find(j)
            head[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def near_copies() -> dict[int, str]:
    """Groups of 5 to 200 copies with changes that leave their pairs close to the threshold, and a passage that many share."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    texts: list[str] = []
    for size in (5, 8, 20, 60, 200):
        base = [word() for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for at in rng.integers(0, 150, rng.integers(1, 8)):
                copy[at] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(90)]
    for _ in range(60):
        own = [word() for _ in range(25)]
        for n in range(rng.integers(1, 3)):
            texts.append(" ".join(passage + own[: len(own) - n] + ["x"] * n))
    return dict(enumerate(texts))


def test_near_duplicates_of_large_groups(spark):
    texts = near_copies()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == brute_classes(texts)


def test_quality_rules_of_boilerplate_hosts(spark):
    """Pages that are nearly all boilerplate are documents of their own; exact copies of one text are not."""
    lines = [" ".join(f"shared{i}x{j}" for j in range(30)) for i in range(3)]
    own = lambda i: "".join(chr(97 + n) for n in (i % 26, i // 26))
    pages = [(i, "\n".join(lines) + f"\n{own(i)} {own(i)}end", "pages") for i in range(60)]
    copies = [(100 + i, " ".join(f"copied{j}" for j in range(40)), "copies") for i in range(60)]
    frame = spark.createDataFrame(pages + copies, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in quality_rules.verdicts(frame).collect()}
    assert all(rows[i].removed_words == 90 and not rows[i].kept for i in range(60))
    assert all(rows[100 + i].removed_words == 0 and rows[100 + i].kept for i in range(60))


def samples(parsed) -> list[str]:
    """One string of every alternative of a pattern, with optional parts and without."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            part = [chr(arg)]
        elif name == "IN":
            part = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name == "BRANCH":
            part = [x for b in arg[1] for x in samples(b)]
        elif name == "SUBPATTERN":
            part = samples(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            part = ([""] if arg[0] == 0 else []) + samples(arg[2])
        else:
            assert name == "ASSERT"
            part = [""]
        out = [a + b for a in out for b in part]
    return out


def test_license_gates_are_necessary():
    for rule in license_rules.rules():
        for x in samples(_parser.parse(rule["pattern"])):
            assert re.search(rule["pattern"], f" {x} "), (rule, x)
            assert any(g in f" {x} " for g in rule["gates"]), (rule["label"], x)


def test_license_words_without_their_usual_gate(spark):
    named = {
        "released under GPLv2": "gpl-2.0", "under lgpl3": "lgpl-3.0", "AGPLv3 only": "agpl-3.0", "data under ODbL 1.0": "odbl", "psf license": "python-2.0",
        "a beer-ware license": "beerware", "mpl2": "mpl-2.0", "ASL 2.0": "apache-2.0", "freebsd": "bsd-2-clause", "zero clause bsd": "0bsd",
    }
    frame = spark.createDataFrame(list(enumerate(named)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    assert [rows[i].labels for i in range(len(named))] == list(named.values()) and all(r.score > 0 for r in rows.values())


def test_pipeline_against_plain_code(spark, tmp_path):
    """Every stage of run() on a small table, by all pairs, exact counts, re and the tokenizer library."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    line = "subscribe to our newsletter and follow us"
    rows = []
    for i in range(40):
        words = [word() for _ in range(60)]
        rows.append((len(rows), f"{line}\n" + " ".join(words), "host"))
        if i % 4 == 0:
            words[30] = "changed"
            rows.append((len(rows), " ".join(words), "other"))
        if i % 8 == 0:
            rows.append((len(rows), rows[-1][1], "other"))
    rows += [(len(rows), "too short", "host"), (len(rows) + 1, None, None), (len(rows) + 2, f"{line}\n{line}\n{line}\n{line}\n{line} " + "a few words", "host")]
    rows.append((len(rows), " ".join(word() for _ in range(50)) + ' password = "hunter2222" ' + word(), "other"))
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    held = collections.defaultdict(set)
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            held[s, x].add(" ".join((t or "").split()))
    of = collections.Counter(s for s, _ in {(s, " ".join((t or "").split())) for _, t, s in rows})
    common = {k for k, v in held.items() if len(v) > quality_rules.LINE_DOCUMENTS and len(v) > quality_rules.LINE_SHARE * of[k[0]]}
    texts = {}
    for i, t, s in rows:
        left = "\n".join(x for x in (t or "").split("\n") if (s, x) not in common)
        n = len((t or "").split())
        if n >= quality_rules.MIN_WORDS and len(left.split()) >= quality_rules.KEEP_SHARE * n:
            seen = collections.Counter(tuple(t.split()[k : k + 8]) for k in range(n - 7))
            if 100 * sum(8 for v in seen.values() if v > 1) <= 30 * n:
                texts[i] = left
    kept = {i: t for i, t in texts.items() if brute_classes(texts)[i] == i}
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for i, t in kept.items():
        ids = library.encode(re.sub(r'password = "[a-z0-9]+', "[SECRET]", t), add_special_tokens=False).ids + [1]
        want[i, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert got == want and 40 <= len(kept) < len(texts) < len(rows)
