"""Benchmark decontamination against plain windows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from chronoloom.llm import decontaminate, queries
from tests.conftest import SMALL
from tests.llm import fixtures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def windows_of(items, least=10):
    return {(str(i) if i is not None else "", tuple(w[a : a + least])) for i, text in items for w in [words_of(text)] for a in range(max(1, len(w) - least + 1)) if w}


def plain(rows, items):
    by_words = {}
    for i, w in windows_of(items):
        by_words.setdefault(w, set()).add(i)
    lengths = {len(w) for w in by_words}
    out = []
    for doc_id, text in rows:
        words, hit, found = words_of(text), set(), set()
        for n in lengths:
            for a in range(len(words) - n + 1):
                if (own := by_words.get(tuple(words[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= own
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


ITEMS = [
    (1, fixtures.prose(1, 40)), (2, fixtures.prose(2, 12)), (3, "Two words"), (10, "two-words, two WORDS"), (4, None), (5, "... !"), (6, "é"), (None, fixtures.prose(3, 10)), (7, "a a a a a a a a a a a a a"),
    (8, fixtures.prose(1, 40)), (8, "other text of the same id"), (9, "x y x y x y x y x y x y z"),
]
ROWS = [
    (1, fixtures.prose(1, 40).upper()), (2, f"head {fixtures.prose(2, 12)} tail"), (3, "these two, words"), (4, None), (5, ""), (6, "é"), (7, "É"), (8, " ".join("a" * 30)), (9, " ".join(fixtures.prose(1, 40).split()[5:14])),
    (10, " ".join(fixtures.prose(1, 40).split()[5:15])), (11, "two"), (12, "words"), (None, f"{fixtures.prose(3, 10)} {fixtures.prose(2, 9)}"), (13, "x y " * 40), (13, "x y " * 40), (14, "b " + "a " * 9), (15, f"{fixtures.prose(1, 40)} {fixtures.prose(9, 3000)} {fixtures.prose(1, 20)}"),
]


def got(spark, rows, items, **kw):
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, spans string, n_words int").repartition(4)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, items int")
    return docs, bench


@pytest.mark.parametrize("some", [ITEMS, [i for i in ITEMS if len(words_of(i[1])) >= 10], [i for i in ITEMS if len(words_of(i[1])) != 1], []])
def test_decontaminate_odd_rows(spark, some):
    docs, bench = got(spark, ROWS, some)
    assert Counter(tuple(r) for r in decontaminate.report(docs, bench).collect()) == plain(ROWS, some)


def test_decontaminate_blocks_and_segments(spark):
    """Many small automata in turn, items in several segments."""
    docs, bench = got(spark, ROWS, ITEMS)
    found = decontaminate.match(docs, bench, block_words=30).collect()
    want = {(r[0], r[1]): (w, n) for r, (_, w, n, _, _, _) in zip(ROWS, [next(iter(plain([r], ITEMS))) for r in ROWS], strict=True)}
    cut = decontaminate.segments(bench, size=7)
    assert cut.where("NOT whole").count() > 3 and decontaminate.automata(cut, 6).count() > 3
    assert all((r.n_words, sum(s.last_word - s.first_word + 1 for s in r.spans)) == want[r.doc_id, r.text] for r in found) and len(found) == len(ROWS)


def test_automaton_longest_matches():
    rng = random.Random(4)
    for _ in range(60):
        made = decontaminate.Automaton(3)
        items = [[rng.choice("abc").encode() for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        for k, item in enumerate(items):
            made.add(str(k), item, True)
        made.finish()
        text = [rng.choice("abcd").encode() for _ in range(40)]
        has = lambda part, items=items: any(item[a : a + len(part)] == part for item in items for a in range(len(item) - len(part) + 1))
        for i, (_, length, found) in enumerate(made.stream(text), 1):
            assert length == max(n for n in range(i + 1) if n == 0 or has(text[i - n : i]))
            ends = {(k, n) for k, item in enumerate(items) for n in [min(3, len(item))] if n <= i and any(item[a : a + n] == text[i - n : i] for a in range(len(item) - n + 1))}
            assert {(k, n) for s, n in found for k in made.windows[s, n]} == ends


def test_decontaminate_removes_spans(spark):
    docs, bench = got(spark, ROWS, ITEMS)
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert rows[2, 14].dropped and rows[2, 14].kept == "" and rows[2, 14].longest == 12
    long = rows[15, 3060]
    assert not long.dropped and long.kept == f" {fixtures.prose(9, 3000)} " and long.coverage == pytest.approx(60 / 3060)
    assert rows[4, 0].kept is None and rows[5, 0].kept == "" and rows[11, 1].kept == "two"
    assert decontaminate.report(fixtures.empty(spark), bench).count() == 0


def test_decontaminate_generated_rows_and_sql(spark):
    docs, items = (pq.read_table(f"{SMALL}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    want = plain([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    assert Counter(tuple(r) for r in queries.op11_decontaminate(spark, SMALL).collect()) == want and any(r[-1] for r in want)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    assert Counter(con.execute(decontaminate.ORACLE_SQL).fetchall()) == want
