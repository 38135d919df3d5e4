"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a folder of this machine is set if driver and executors are one process, as in tests; on a
    cluster that is an error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/chronoloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` written to `path`, else to a new shared folder, and read again: lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a stored folder that no table reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 32 bits of their md5."""
    joined = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranked(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """`df` with `rank`, its place from 1 in the order of the hexadecimal column `key`, and `total`, the number of rows.

    No task sees all rows: rows are counted by the key's first three digits, these at most 4096 counts are added up, and each
    such range is ordered by itself.
    """
    rows = df.withColumn("_range", F.substring(key, 1, 3))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("total"))
    rows = rows.join(counts, "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties))
    return rows.withColumn("rank", (F.col("_before") + inside).cast("long")).drop("_range", "_before")
