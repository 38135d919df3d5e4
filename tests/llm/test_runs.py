"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq

from chronoloom.llm import queries, runs
from tests.conftest import SMALL
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, length, period) of all runs, by start, then period."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + q - start >= max(6, 4 * q):
                    best.setdefault((start, i + q), q)
                start = None
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def of_ids(ids):
    words, group = runs.stretches(np.array(ids, np.uint64), np.array([0, len(ids)]))
    if not len(words):
        return []
    symbols = np.unique(group * 1000 + np.array(ids)[words], return_inverse=True)[1]
    return [(int(words[s]), int(e - s), int(q)) for s, e, q in zip(*runs.runs_of(symbols, group), strict=True)]


def derived(g):
    """What the grammar derives."""
    todo, out = list(g.symbols[::-1]), []
    while todo:
        x = int(todo.pop())
        if x < g.terminals:
            out.append(x)
        else:
            todo += [g.right[x - g.terminals], g.left[x - g.terminals]]
    return out


def cases():
    rng = random.Random(8)
    for _ in range(300):
        size, letters = rng.randrange(0, 70), rng.choice([1, 2, 2, 3])
        yield [rng.randrange(letters) for _ in range(size)]
    for _ in range(200):  # powers inside of powers
        base = [rng.randrange(3) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 7) + [rng.randrange(4)]
        yield [rng.randrange(5) for _ in range(rng.randrange(5))] + base * rng.randrange(2, 8) + base[: rng.randrange(len(base))] + [rng.randrange(5) for _ in range(rng.randrange(5))]
    a, b = [0], [1]
    for _ in range(9):
        a, b = a + b, a
    yield a  # Fibonacci's word has no fourth power
    yield [0] * 500
    yield [bin(i).count("1") % 2 for i in range(512)]  # Thue and Morse's has no third one


def test_runs_of_symbols():
    for ids in cases():
        assert of_ids(ids) == plain_runs(ids), ids
        g = runs.grammar(np.array(ids, np.int64), np.zeros(len(ids), np.int64)) if ids else None
        assert not ids or derived(g) == ids
        assert not ids or len(g.symbols) == 1


def test_grammar_is_small():
    ids = np.array(list(range(40)) * 512)
    g = runs.grammar(ids, np.zeros(len(ids), np.int64))
    assert len(g.left) < 40 + 4 * 9 + 12 and len(g.rounds) < 40  # a period and its powers
    assert list(zip(*(x.tolist() for x in runs.runs_of(ids, np.zeros(len(ids), np.int64))), strict=True)) == [(0, len(ids), 40)]


def plain_row(doc_id, text, planted=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


REPEATED = [
    (900 + i, t)
    for i, t in enumerate(["a b " * 40, "x " * 6, "x " * 5, "one two three\n" * 4 + "end", "a a a a a a b " * 9, "é\x85 é\x85\té\x85 é\x85 é\x85 é\x85", " ".join(f"w{k}" for k in range(60)) * 5, "p q r s " * 3 + "p q r", "p q r s " * 4 + "p q r z z z z z z z"])
]


def test_runs_odd_rows(spark):
    rows = [r for r in fixtures.odd_rows() if r[0] != 315] + [(*r, None, None, None, 1, "", "", 0) for r in REPEATED * 2]
    docs = fixtures.odd(spark, rows)
    want = Counter(plain_row(r[0], r[1]) for r in rows)
    assert Counter(tuple(r) for r in runs.report(docs, queries._periodic_tail).collect()) == want
    assert Counter(tuple(r) for r in runs.report(docs).collect()) == Counter(plain_row(r[0], r[1], False) for r in rows)
    assert runs.report(fixtures.empty(spark)).count() == 0


def test_runs_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "say it now: ha ha ha ha ha ha ho", "clash"), (2, None, "clash"), (3, "", "clash"), (4, "a b c\n" * 5, None)], "doc_id long, text string, runs string")
    rows = {r.doc_id: r for r in runs.collapse(docs, ("doc_id",)).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(3, 6, 1)] and rows[1].collapsed == "say it now: ha ho"
    assert rows[2].collapsed is None and rows[3].collapsed == "" and rows[4].collapsed == "a b c" and rows[2].runs == []


def test_runs_generated_rows(spark):
    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    want = Counter(plain_row(r["doc_id"], r["text"]) for r in rows)
    assert Counter(tuple(r) for r in queries.op12_runs(spark, SMALL).collect()) == want
    assert sum(r[1] > 0 for r in want) > 10
