"""JSON files parsed once: a ledger of path, size and time tells which are new or changed.

The parsed files are a bucketed table with versions (`tables`), a row for each, which is the ledger too. A refresh lists the files (`listing`), which
reads none of them, parses those that the ledger doesn't have in this size and of this time, and takes out those that are gone. Files that don't
parse are rows as well, with their text, so they aren't tried again until they change, and are read by themselves. A file without a byte
is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.storage import stored

from . import listing, tables
from .files import small_files

SEEN = ["path", "modificationTime", "length"]


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return listing.dealt(listing.listed(spark, root, name).where("length > 0"))


def refresh(spark: SparkSession, root: str, name: str, schema: str, table: str) -> dict[str, int]:
    """Brings the table up to the files `name` below `root`. Returns how many were parsed, how many of these are bad, and how many are gone.

    A file is one object of `schema` or it is bad. Contents are read of files that are due alone.
    """
    with small_files(spark):
        now = _files(spark, root, name)  # once
    known = tables.read(spark, table).select(*SEEN) if tables.snapshot(spark, table) else now.limit(0)
    one = lambda rows, name: rows.select("path", F.struct("modificationTime", "length").alias(name))
    both = stored(one(now, "now").join(one(known, "was"), "path", "full"))  # no side of it is ever broadcast: paths are few bytes in a file, many in memory
    due = both.where("now IS NOT NULL AND NOT now <=> was").select("path", "now.*")
    gone = both.where("now IS NULL").select("path")
    parsed, removed = due.count(), gone.count()
    if not parsed and not removed:
        return {"parsed": 0, "bad": 0, "gone": 0}
    with small_files(spark):
        rows = listing.contents(due, root, name)
    text = F.decode("content", "utf-8")
    rows = rows.select(*SEEN, text.alias("text"), F.from_json(text, f"struct<{schema}, _corrupt_record: string>", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("value"))
    bad = F.col("value").isNull() | F.col("value._corrupt_record").isNotNull()
    rows = rows.select(*SEEN, F.when(bad, F.col("text")).alias("bad"), F.when(~bad, F.col("value").dropFields("_corrupt_record")).alias("value"))
    rows = tables.write(rows, table, "path", documents=gone if removed else None)
    return {"parsed": parsed, "bad": rows.where("bad IS NOT NULL").count(), "gone": removed}


def read(spark: SparkSession, table: str) -> DataFrame:
    """`path` and the fields of all files that parse."""
    return tables.read(spark, table).where("bad IS NULL").select("path", "value.*")


def read_bad(spark: SparkSession, table: str) -> DataFrame:
    """`path`, `text` of the files that don't parse."""
    return tables.read(spark, table).where("bad IS NOT NULL").select("path", F.col("bad").alias("text"))
