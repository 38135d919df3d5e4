"""Bucketed tables with versions: what is read, what isn't shuffled, and what a failed write leaves."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.sources import tables


def rows(spark, ids, v):
    return spark.createDataFrame([(i, k, v) for i in ids for k in (1, 2)], "doc_id long, event_no long, v string")


def content(spark, path):
    return {(r.doc_id, r.event_no): r.v for r in tables.read(spark, path).collect()}


def all_of(ids, v):
    return {(i, k): v for i in ids for k in (1, 2)}


def test_versions_replace_documents(spark, tmp_path):
    path = str(tmp_path / "t's")
    tables.write(rows(spark, range(40), "a"), path, buckets=4)
    tables.write(rows(spark, [3, 50], "b"), path)
    assert content(spark, path) == all_of([i for i in range(40) if i != 3], "a") | all_of([3, 50], "b")
    tables.write(rows(spark, [4], "c"), path, documents=spark.createDataFrame([(4,), (5,), (99,)], "doc_id long"))
    want = all_of([i for i in range(40) if i not in (3, 4, 5)], "a") | all_of([3, 50], "b") | all_of([4], "c")
    assert content(spark, path) == want
    before = tables.read(spark, path)
    tables.compact(spark, path, buckets=2)
    assert content(spark, path) == want and tables.snapshot(spark, path)["buckets"] == 2
    assert before.count() == len(want)  # a reader of the versions before goes on


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_no_exchange_by_document(spark, tmp_path):
    """Joins, windows and aggregates of two tables, with several versions each, even where nothing is broadcast."""
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for path in (one, two):
        tables.write(rows(spark, range(30), "a"), path, buckets=8)
        tables.write(rows(spark, range(0, 30, 2), "b"), path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = tables.read(spark, one), tables.read(spark, two)
        joined = a.join(b.select("doc_id", F.col("v").alias("w")), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
        ranked = a.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("event_no")))
        assert exchanges(joined) == 0 and exchanges(ranked) == 0
        assert joined.count() == 30 and {r.n for r in joined.collect()} == {4}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_failed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path)
    tables.write(rows(spark, range(5), "a"), path, buckets=2)
    broken = rows(spark, range(5), "b").withColumn("v", F.when(F.col("doc_id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        tables.write(broken, path)
    assert content(spark, path) == all_of(range(5), "a")
    whole = tables._committed

    def stopped(spark, path, version, *rest):
        monkeypatch.setattr(spark, "createDataFrame", None)  # ends before the snapshot, after the rows
        whole(spark, path, version, *rest)

    monkeypatch.setattr(tables, "_committed", stopped)
    with pytest.raises(TypeError):
        tables.write(rows(spark, [1], "c"), path)
    monkeypatch.undo()
    assert content(spark, path) == all_of(range(5), "a")
    tables.write(rows(spark, [2], "d"), path)
    assert content(spark, path) == all_of([0, 1, 3, 4], "a") | all_of([2], "d")


def test_buckets_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_BYTES", 400)
    path = str(tmp_path / "t")
    tables.write(rows(spark, range(500), "a"), path)
    n = tables.snapshot(spark, path)["buckets"]
    assert n > 4 and n & (n - 1) == 0 and tables.read(spark, path).count() == 1000
    tables.write(rows(spark, [], "a"), str(tmp_path / "none"))
    assert tables.read(spark, str(tmp_path / "none")).count() == 0


def test_rows_that_files_hold_in_few_bytes_are_spread(spark, tmp_path, monkeypatch):
    """A hundred thousand equal rows are a small file, but not a small sort."""
    monkeypatch.setattr(tables, "BUCKET_BYTES", 2 << 20)
    path = str(tmp_path / "t")
    tables.write(spark.range(100_000).select("id", F.lit("x").alias("v")).withColumnRenamed("id", "doc_id").withColumn("n", F.lit(1)), path)
    assert 4 <= tables.snapshot(spark, path)["buckets"] <= 16 and tables.read(spark, path).count() == 100_000
