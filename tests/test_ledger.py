"""Files that are parsed once."""

import os
from collections import Counter

import duckdb
import pytest

from chronoloom.plans import catalog
from chronoloom.sources import files, ledger

SCHEMA = "doc_id string, n int"


def put(path, text):
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(text)


def test_only_new_and_changed_files_are_parsed(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "table")
    for k in range(6):
        put(root / f"d{k}" / "graph.json", f'{{"doc_id": "D{k}",\n "n": {k}}}')
    put(root / "d6" / "graph.json", "{broken")
    put(root / "d0" / "other.json", "{}")
    go = lambda: ledger.refresh(spark, str(root), "graph.json", SCHEMA, table)
    rows = lambda: Counter((r.doc_id, r.n) for r in ledger.read(spark, table).collect())
    assert go() == {"parsed": 7, "bad": 1, "gone": 0}
    assert rows() == Counter((f"D{k}", k) for k in range(6))
    assert [r.text for r in ledger.read_bad(spark, table).collect()] == ["{broken"]
    assert go() == {"parsed": 0, "bad": 0, "gone": 0}  # none again, bad ones neither
    put(root / "d1" / "graph.json", '{"doc_id": "D1", "n": 100}')
    put(root / "d6" / "graph.json", '{"doc_id": "D6", "n": 6}')
    put(root / "d7" / "graph.json", " ")
    os.remove(root / "d2" / "graph.json")
    assert go() == {"parsed": 3, "bad": 1, "gone": 1}
    assert rows() == Counter([("D0", 0), ("D1", 100), ("D3", 3), ("D4", 4), ("D5", 5), ("D6", 6)])
    assert go() == {"parsed": 0, "bad": 0, "gone": 0}


def test_document_inputs_in_order(spark, tmp_path):
    for name in ("B2", "A10", "A9", "A9_a", "build_summary", "nothing"):
        put(tmp_path / f"{name}.json", f'{{"doc_name": "{name}", "doc_text": "t",\n"events": {{"E1": "a"}}}}')
    read = lambda **kw: [r.doc_name for r in files.read_document_inputs(spark, str(tmp_path), **kw).collect()]
    assert read() == ["A9", "A10", "A9_a", "B2", "nothing"]
    assert read(doc_ids=["A9", "B2"]) == ["A9", "A9_a", "B2"]
    assert read(doc_ids=["A9", "B2"], limit=2) == ["A9", "A9_a"] and read(limit=0) == []


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_named_files(spark, tmp_path, scheme):
    rows = spark.createDataFrame([("a.txt", "x"), ("b/c.txt", "é\n"), ("a/d.txt", "")], "name string, content string")
    assert files.write_named(rows, f"{scheme}{tmp_path}/out") == 3
    assert files.write_named(rows.where("name = 'a.txt'"), f"{scheme}{tmp_path}/out") == 1
    assert (tmp_path / "out/b/c.txt").read_text() == "é\n" and sorted(os.listdir(tmp_path / "out")) == ["a", "a.txt", "b"]
    assert files.write_named(rows.limit(0), f"{scheme}{tmp_path}/none") == 0


def test_files_of_documents_with_long_ids(spark, tmp_path):
    """Ids of six and seven digits, of which names have five: files of equal names are all kept, as the SQL has them."""
    ids = [7, 12345, *range(123450, 123460), *range(1234560, 1234563)]
    rows = [(d, f"text {d}\nsecond", "en", "web") for d in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        for name in ("read_source_texts", "read_source_texts_issues", "read_document_inputs", "read_checkpoints"):
            got = catalog.queries()[name](spark, str(tmp_path))
            want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
            assert Counter(map(tuple, got.collect())) == Counter(want), name


def test_many_small_files_are_few_tasks_and_listed_once(spark, tmp_path, monkeypatch):
    files.write_named(spark.range(400).selectExpr("concat('d', id, '/graph.json') AS name", "concat('{\"doc_id\": \"D', id, '\", \"n\": 1}') AS content"), str(tmp_path / "in"))
    whole = lambda: ledger._files(spark, str(tmp_path / "in"), "graph.json")
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    plain = whole().rdd.getNumPartitions()
    with files.small_files(spark):
        assert whole().rdd.getNumPartitions() <= 8 < plain
    assert spark.conf.get("spark.sql.files.openCostInBytes") == was
    calls, listing = [], ledger._files
    monkeypatch.setattr(ledger, "_files", lambda *a: calls.append(a) or listing(*a))
    assert ledger.refresh(spark, str(tmp_path / "in"), "graph.json", SCHEMA, str(tmp_path / "table"))["parsed"] == 400
    assert len(calls) == 1
