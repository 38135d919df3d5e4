"""Files listed and read by tasks: the same by Spark's reader, and no name of a file in the driver."""

import os
import re
from collections import Counter

import duckdb
import pytest

from chronoloom.plans import catalog
from chronoloom.sources import files, ledger, listing


def put(path, text):
    os.makedirs(path.parent, exist_ok=True)
    path.write_bytes(text)


@pytest.fixture
def tree(tmp_path):
    for name in ("a/x.txt", "a/sub/y.txt", "b/x.txt", "b/sub/deep/w é+%20.txt", "b/x.json", "c.txt"):
        put(tmp_path / "in" / name, name.encode() + b"\xff\n")
    put(tmp_path / "in/b/empty.txt", b"")
    for name in ("a/.x.txt", "a/_x.txt", ".a/x.txt", "_a/x.txt", "a/z.txt._COPYING_"):
        put(tmp_path / "in" / name, b"hidden")
    return tmp_path


@pytest.fixture
def far(spark, tree):
    """The folder by a path that only Spark opens."""
    store = re.sub("[^a-z0-9]", "", tree.name)  # a store of another name in each test: Spark keeps stores
    key = f"fs.viewfs.mounttable.{store}.link./far"
    spark.conf.set(key, f"file://{tree}")
    yield f"viewfs://{store}/far"
    spark.conf.unset(key)


WANTED = [("in", "*.txt", True, 6), ("in", "*.txt", False, 1), ("in/b", "*.txt", False, 2), ("in/*", "*.txt", False, 6), ("in/[ab]", "x.{txt,json}", True, 3), ("in/{a,c}*", "?.txt", True, 3), ("in/*/s?b", "*", False, 1)]


def test_listed_by_tasks_and_by_spark(spark, tree, far):
    def all_of(top, root, name, nested):
        found = listing.listed(spark, f"{top}/{root}", name, nested)
        rows = listing.contents(found, f"{top}/{root}", name, nested).collect()
        return {re.sub(".*/in/", "", r.path): (r.length, bytes(r.content), r.length and r.modificationTime) for r in rows}, len(rows)

    for root, *what, many in WANTED:
        assert listing._top(spark, f"{tree}/{root}") and listing._top(spark, f"{far}/{root}") is None
        got, n = all_of(str(tree), root, *what)
        assert n == len(got) == many and (got, n) == all_of(far, root, *what), (root, what)
        assert all(content == (b"hidden" if length == 6 else path.encode() + b"\xff\n" if length else b"") for path, (length, content, _) in got.items())
    assert all_of(f"file://{tree}", "in", "*.txt", True) == all_of(str(tree), "in", "*.txt", True)


def test_no_name_of_a_file_is_in_the_driver(spark, tmp_path):
    for k in range(60):
        put(tmp_path / f"in/d{k}/graph.json", b'{"doc_id": "D", "n": 1}')
        put(tmp_path / f"runs/r{k}/latest_meta.json", b'{"epoch": 1, "val_loss": 2.0}')
        put(tmp_path / f"texts/AB{k}.txt", b"text")
    docs, issues = files.read_source_texts(spark, str(tmp_path / "texts"))
    runs = files.run_metrics(spark, str(tmp_path / "runs"))
    listed = ledger._files(spark, str(tmp_path / "in"), "graph.json")
    assert docs.count() == runs.count() == listed.count() == 60 and issues.count() == 0
    for rows in (docs, issues, runs, listed):
        assert not any(str(tmp_path) in name for name in rows.inputFiles())


def test_a_refresh_broadcasts_no_paths(spark, tmp_path, monkeypatch):
    """Paths are few bytes in a file, so that Spark would broadcast all of them."""
    for k in range(30):
        put(tmp_path / f"in/d{k}/graph.json", b'{"n": 1}')
    plans, go = [], lambda: ledger.refresh(spark, str(tmp_path / "in"), "graph.json", "n int", str(tmp_path / "table"))
    for module in (ledger, ledger.tables, files):
        monkeypatch.setattr(module, "stored", lambda df, path=None, f=module.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, path))
    monkeypatch.setattr(ledger.tables, "_committed", lambda spark, path, version, rows, *a, f=ledger.tables._committed: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or f(spark, path, version, rows, *a))
    assert go() == {"parsed": 30, "bad": 0, "gone": 0}
    os.remove(tmp_path / "in/d3/graph.json")
    put(tmp_path / "in/d4/graph.json", b'{"n": 22}')
    assert go() == {"parsed": 1, "bad": 0, "gone": 1}
    assert Counter(r.n for r in ledger.read(spark, str(tmp_path / "table")).collect()) == {1: 28, 22: 1}
    assert len(plans) >= 6 and not any("BroadcastExchange" in plan for plan in plans)


def test_documents_without_text_are_read(spark, tmp_path):
    """A text of no byte is a file of no byte, which Spark's reader passes over."""
    rows = [(d, None if d % 7 == 1 else "" if d % 7 == 2 else f"text {d}", "en", "web") for d in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        for name in ("read_source_texts", "read_source_texts_issues"):
            got = catalog.queries()[name](spark, str(tmp_path))
            want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
            assert Counter(map(tuple, got.collect())) == Counter(want), name
