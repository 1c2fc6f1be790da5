"""Conversation trie, hard negatives and line deduplication against brute force and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from changeguard.llm import hard_negatives, line_dedup, prefix_trie
from tests.llm.data import awkward, none

TURNS = "conv_id long, turn long, role string, text string, conv string, at string, node string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "c", "a", "n") for r in rows], TURNS)


def trie_by_hand(rows):
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [x[2:] for x in sorted(v)] for c, v in held.items()}
    whole = {}
    for c, v in held.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = held.get(base, [])[:h] + v[h:]
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def trie_of(spark, rows):
    return collections.Counter(tuple(r) for r in prefix_trie.conversation_trie(conversations(spark, rows)).collect())


def test_trie_against_brute_force(spark):
    """Few different turns, so that prefixes are shared; lengths around powers of two; a third of all conversations are one."""
    rng = random.Random(5)
    rows = []
    for c in range(-25, 130):
        for t in range(3 if c % 3 == 0 else rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17])):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "hello  there" if c % 3 == 0 else rng.choice(["a b", "c", "one two three"])))
    rng.shuffle(rows)
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_of_long_and_awkward_conversations(spark):
    """A conversation of 300 turns, NULLs, a turnless rebuilt conversation, repeated rows, an id without a base."""
    bare = next(c for c in range(1000, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(300)] + [(41, t, "user", f"turn {t % 7}") for t in range(299)]
    rows += [(60, None, None, None), (60, None, None, None), (60, 3, "user", "x" * 50_000), (61, 1, "", ""), (62, 5, "user", None), (None, 1, "user", "lost"), (bare, 0, "user", "gone")]
    got = trie_of(spark, rows)
    assert got == trie_by_hand(rows)
    assert sum(k[1] == 0 for k in got) == 1


def test_trie_of_little(spark):
    bare = next(c for c in range(1000, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert prefix_trie.conversation_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0
    for rows in ([(bare, 0, "user", "gone")], [(0, 0, "user", "one turn"), (20, 0, "user", "one turn")]):
        assert trie_of(spark, rows) == trie_by_hand(rows)


def test_ids_of_a_hot_node_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    rows = [(c * 20, 0, "user", "all the same") for c in range(400)]
    assert trie_of(spark, rows) == trie_by_hand(rows)


VECTORS = "vec_id long, embedding array<float>, label int, parts string, score string, akey string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, "p", "s", "k") for i, v, k in rows], VECTORS)


def negatives_by_hand(rows, positives=5, negatives=10):
    ok = [(i, [np.floor(256 * float(np.float32(x))) for x in v], (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in rows
          if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in ok), default=1)
    x = np.array([[int(c) for c in v] + [0] * (width - len(v)) for _, v, _ in ok], dtype=np.int64).reshape(len(ok), width)
    ids, labels, out, asked = np.array([i for i, _, _ in ok]), np.array([k for _, _, k in ok]), [], set()
    for a in np.flatnonzero(ids % 100 == 0) if len(ok) else ():
        name = (ids[a], labels[a], x[a].tobytes())
        if name in asked:
            continue
        asked.add(name)
        score = x @ x[a]
        order = np.lexsort((ids, -score))
        for p in [o for o in order if labels[o] == labels[a] and ids[o] != ids[a]][:positives]:
            hard = [o for o in order if labels[o] != labels[a] and 30 * score[p] <= 100 * score[o] <= 90 * score[p]][:negatives]
            out += [(ids[a], ids[p], n + 1, ids[o], score[p], score[o]) for n, o in enumerate(hard)]
    return collections.Counter(tuple(map(int, r)) for r in out)


def mined(spark, rows):
    return collections.Counter(tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect())


@pytest.mark.parametrize("width", [1, 3, 64, 100])
def test_hard_negatives_against_brute_force(spark, width, monkeypatch):
    """Clusters, ties, equal vectors, vectors of another length; several blocks of rows and of anchors."""
    monkeypatch.setattr(hard_negatives, "ROW_BYTES", 64 * 4 * 128)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 4 * 4 * 128)
    rng = np.random.default_rng(width)
    centers = rng.normal(size=(6, width))
    rows = [(i, centers[i % 6] + 0.4 * rng.normal(size=width) if i % 4 else centers[i % 5], int(rng.integers(0, 10))) for i in range(1200)]
    rows += [(2000 + i, rng.normal(size=max(1, width // 2)), i % 10) for i in range(40)]
    assert mined(spark, rows) == negatives_by_hand(rows)


def test_hard_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8), i % 3) for i in range(150)]
    rows += [(200, None, 1), (300, [1.0] * 8, None), (None, [1.0] * 8, 1), (400, [float("nan")] * 8, 1), (500, [float("inf")] * 8, 1), (600, [None] * 8, 1), (700, [], 1), (800, [0.0] * 8, 2)]
    rows += [(100, rows[100][1], rows[100][2]), (33, rows[33][1], rows[33][2]), (-100, rng.normal(size=8), 1), (101, [1000.0] * 8, 1), (103, [-1000.0] * 8, 2)]
    assert mined(spark, rows) == negatives_by_hand(rows)
    assert mined(spark, []) == {} and mined(spark, [(1, [1.0], 1)]) == {}
    assert mined(spark, [(100, [1e30], 1), (200, [1.0], 1)]) == {}


def test_intervals_hold_every_product():
    rng = np.random.default_rng(3)
    for width in (1, 2, 64, 256):
        rows, anchors = rng.integers(-300, 300, (200, width)).astype(float), rng.integers(-300, 300, (20, width)).astype(float)
        rows[0], anchors[0], rows[1] = 0, 0, anchors[1]
        low, high = hard_negatives.intervals(anchors, *hard_negatives.encode(rows))
        exact = anchors @ rows.T
        assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.3 * np.ptp(exact)


def lines_by_hand(rows, least=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fold)
    at = lambda i: (i is None, i or 0)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(at(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < least or at(i) == min(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return collections.Counter(out)


def test_lines_against_brute_force(spark):
    rng = random.Random(9)
    pool = ["A common LINE here", "  a common line here\t", "a common line here", "short", "nine char", "exactly 10", "É common line here", "é common line here", "", "   ", "漢字漢字漢字漢字漢字"]
    rows = [(i % 70 if i % 9 else None, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line number {rng.randrange(200)} of some text" for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, "\n"), (3, "\n\n"), (None, None), (500, "\r\n".join(["with a return"] * 3)), (501, "with a return"), (502, "with a return \n"), rows[5], rows[5]]
    rows += [(600, "\n".join(f"line number {k % 300} of some text" for k in range(20_000)))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_lines string, gone string")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "n_dropped"]
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == lines_by_hand(rows)


def test_lines_over_a_threshold(spark):
    docs = spark.createDataFrame([(i, f"in all documents\nin two of them {i // 2}\nonly in this one {i}") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least_docs=3).collect()}
    assert got[0].startswith("in all") and got[5] == "in two of them 2\nonly in this one 5"


def test_lines_of_awkward_tables(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    got = line_dedup.dedup_lines(awkward(spark))
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == lines_by_hand(rows)
    assert line_dedup.dedup_lines(none(spark)).count() == 0
