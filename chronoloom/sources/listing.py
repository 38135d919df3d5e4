"""Very many files listed and read by tasks, so that the driver holds none of their names.

Folders are listed level by level, a level's folders dealt over tasks, and the files found are a stored table: the driver has the root and
the patterns alone. A folder is listed by one task. Tasks open files as `write_named` does; a store that only Spark opens is listed and
read by Spark's reader, which keeps a status of each file in the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.storage import stored

FOUND = "path string, folder boolean, changed long, length long"
#: Rows found, and bytes read, that a task hands on at once.
TOGETHER, BYTES = 10_000, 8 << 20


def _pattern(glob: str) -> re.Pattern:
    """A pattern of names as Hadoop writes them: `*`, `?`, `[a-z]`, `[^a-z]`, `{one,two}` and escapes."""
    parts, depth = [], 0
    for part in re.findall(r"\\.|\[[^\]]+\]|.", glob, re.DOTALL):
        depth += (part == "{") - (part == "}" and depth > 0)
        if part[0] == "[" and len(part) > 1:
            parts.append(part)
        elif part == "," and depth:
            parts.append("|")
        else:
            parts.append({"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(part) or re.escape(part[-1]))
    return re.compile("".join(parts), re.DOTALL)


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _batch(found: list[tuple[str, bool, int, int]]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "folder": pa.bool_(), "changed": pa.int64(), "length": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _top(spark: SparkSession, root: str) -> tuple[str, str, list[str]] | None:
    """The folder above the first pattern in `root`, what its paths have before the store's own, and the patterns; null if only Spark opens it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    first = re.search(r"/[^/]*[*?\[{]", whole)
    top, patterns = (whole[: first.start()], whole[first.start() + 1 :].split("/")) if first else (whole, [])
    try:
        store, own = _store(top)
        if not top.endswith(own) or store.get_file_info(own).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    return top, top.removesuffix(own), patterns


def _by_spark(spark: SparkSession, root: str, name: str, nested: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", nested).option("pathGlobFilter", name).load(root)


def listed(spark: SparkSession, root: str, name: str, nested: bool = True) -> DataFrame:
    """`path`, `modificationTime`, `length` of the files `name` in `root`, which may be a pattern of folders; `nested`: and in all folders below."""
    top = _top(spark, root)
    if top is None:
        return _listed_by_spark(spark, root, name, nested)
    start, before, patterns = top
    wanted, found, depth = _pattern(name), [], 0
    level = spark.createDataFrame([(start,)], "path string").coalesce(1)
    while True:
        own = _pattern(patterns[depth]) if depth < len(patterns) else None
        files, folders = depth >= len(patterns) - 1, nested or depth < len(patterns)

        def run(batches: Iterator[pa.RecordBatch], own: re.Pattern | None = own, files: bool = files, folders: bool = folders) -> Iterator[pa.RecordBatch]:
            store = _store(start)[0]
            held: list[tuple[str, bool, int, int]] = []
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    for x in store.get_file_info(fs.FileSelector(folder.removeprefix(before))):
                        is_folder, shown = x.type == fs.FileType.Directory, not _hidden(x.base_name)
                        if (own is None or own.fullmatch(x.base_name)) and (folders and (own or shown) if is_folder else files and shown and wanted.fullmatch(x.base_name)):
                            held.append((before + x.path, is_folder, (x.mtime_ns or 0) // 1_000_000, 0 if is_folder else x.size))
                    while len(held) >= TOGETHER:
                        yield _batch(held[:TOGETHER])
                        held = held[TOGETHER:]
            yield _batch(held)

        rows = stored(level.mapInArrow(run, FOUND))
        found.append(rows.where("NOT folder"))
        level = rows.where("folder").select("path")
        depth += 1
        if not folders or level.isEmpty():
            break
        level = level.repartition(4 * spark.sparkContext.defaultParallelism)  # by number
    every = found[0]
    for rows in found[1:]:
        every = every.union(rows)
    return every.select("path", F.timestamp_millis("changed").alias("modificationTime"), "length")


def _listed_by_spark(spark: SparkSession, root: str, name: str, nested: bool) -> DataFrame:
    """Spark's reader has no row for a file without a byte, but names it."""
    rows = _by_spark(spark, root, name, nested)
    some = stored(rows.select("path", "modificationTime", "length", F.col("_metadata.file_path").alias("uri")))
    every = spark.createDataFrame([(x,) for x in rows.inputFiles()], "uri string")
    none = every.join(some.hint("merge"), "uri", "left_anti").select(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"))
    return some.drop("uri").unionByName(none)


def dealt(rows: DataFrame) -> DataFrame:
    """Files in as many tasks as Spark's reader makes of them by its settings, one for each core at least."""
    spark = rows.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-(size + n * conf.filesOpenCostInBytes()) // conf.filesMaxPartitionBytes())))


def contents(rows: DataFrame, root: str, name: str, nested: bool = True) -> DataFrame:
    """`rows` of the files listed, with any columns beside, and their `content`."""
    spark = rows.sparkSession
    top = _top(spark, root)
    if top is None:
        read = rows.join(_by_spark(spark, root, name, nested).select("path", "content"), "path", "left")
        return read.withColumn("content", F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.col("content"))).select(*rows.columns, "content")
    start, before, _ = top
    names = [*rows.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(start)[0]
        for batch in batches:
            held, size, done = [], 0, 0
            for path in batch.column(names.index("path")).to_pylist():
                with store.open_input_file(path.removeprefix(before)) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BYTES or done + len(held) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(done, len(held)).columns, pa.array(held, pa.binary())], names=names)
                    held, size, done = [], 0, done + len(held)

    return dealt(rows).mapInArrow(run, rows.select("*", F.lit(b"").alias("content")).schema)
