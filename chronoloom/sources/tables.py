"""Per-document results as bucketed tables with versions.

A table is a folder. Each write adds a version: the rows of some documents, clustered by document in as many buckets as the first version's
bytes in memory need, written by Spark's bucketed writer. Then a snapshot is written that names the live versions; it is the last step, so a
write that fails leaves what was there. A version replaces all rows of its documents, those that it has no rows of included; nothing
else is written again. Readers register the live versions as a bucketed table, take each document's last version inside its bucket, and keep
the bucketing: joins, windows and aggregates by document need no exchange. `compact` makes one version of all.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.storage import stored

#: Bytes of a bucket in the first version, in memory, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 1 << 16
#: Bytes of a row in memory and of each of its fields, while a task sorts it.
ROW_BYTES, FIELD_BYTES = 64, 24
SNAPSHOT = "version string, key string, buckets int, columns string, live array<string>"
#: Columns of a version beside the results: whether the row only says that its document has none.
GONE = "_gone"


def snapshot(spark: SparkSession, path: str) -> dict | None:
    """The last complete snapshot of the table at `path`."""
    try:
        rows = spark.read.schema(SNAPSHOT).json(f"{path}/snapshots/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.orderBy(F.desc("version")).first()  # a row for each write
    return last.asDict() if last else None


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _name() -> str:
    return f"chronoloom_{uuid.uuid4().hex}"


def _committed(spark: SparkSession, path: str, version: str, rows: DataFrame, key: str, buckets: int, live: list[str]) -> None:
    """The rows of a new version, then its snapshot."""
    name = _name()
    own = rows.repartition(buckets, key)  # a file for each bucket
    own.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/data/version={version}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema)
    spark.createDataFrame([(version, key, buckets, columns, [*live, version])], SNAPSHOT).coalesce(1).write.json(f"{path}/snapshots/{version}")


def _buckets(rows: DataFrame) -> int:
    """A power of two, so that tables of unlike sizes still divide into each other's buckets."""
    files = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = max(files, rows.count() * (ROW_BYTES + FIELD_BYTES * len(rows.columns)))  # files may be a hundredth of what a task sorts
    return min(MOST_BUCKETS, 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length())


def write(df: DataFrame, path: str, key: str = "doc_id", documents: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """`df` as the rows of its documents from now on; of those in `documents` that it has no row of, there are none any more. Returns `df` as stored."""
    spark = df.sparkSession
    was = snapshot(spark, path)
    rows = stored(df)
    if was:
        buckets = was["buckets"]
    buckets = buckets or _buckets(rows)
    marked = rows.withColumn(GONE, F.lit(False))
    if was and documents is not None:
        none = documents.select(key).distinct().join(rows.select(key).hint("merge"), key, "left_anti")  # keys are few bytes in a file, many if broadcast
        marked = marked.unionByName(none.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
    number = int(was["version"].partition("-")[0]) + 1 if was else 1
    _committed(spark, path, f"{number:08d}-{uuid.uuid4().hex}", marked, key, buckets, was["live"] if was else [])
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all documents, bucketed by document."""
    now = snapshot(spark, path)
    if now is None:
        raise FileNotFoundError(f"no complete version at {path}")
    name, key = _name(), now["key"]
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({now['columns']}, version string) USING parquet PARTITIONED BY (version) CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {now['buckets']} BUCKETS LOCATION '{location}/data'")
    spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (version='{v}') LOCATION '{location}/data/version={v}'" for v in now["live"]))
    rows = spark.table(name)
    if len(now["live"]) > 1:
        rows = rows.withColumn("_last", F.max("version").over(Window.partitionBy(key))).where("version = _last").drop("_last")
    return rows.where(f"NOT {GONE}").drop(GONE, "version")


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """One version of all that is live, in as many buckets as it needs now. The versions before stay for readers that began with them."""
    was = snapshot(spark, path)
    if was is None:
        return
    rows = stored(read(spark, path))
    number = int(was["version"].partition("-")[0]) + 1
    _committed(spark, path, f"{number:08d}-{uuid.uuid4().hex}", rows.withColumn(GONE, F.lit(False)), was["key"], buckets or _buckets(rows), [])
