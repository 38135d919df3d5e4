"""Readers and writers of event graphs, texts, documents, scores, labels, checkpoints, traces and run metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.storage import stored
from chronoloom.operators.documents import NO_NUMBER, extract_doc_id

from . import listing

CAUSAL = "array<struct<cause:string,effect:string,reason:string,supporters:array<string>,manual_review:boolean>>"
TEMPORAL = "array<struct<source:string,target:string,reason:string,score:double,span:int,manual_review:boolean>>"
GRAPH = f"doc_id string, doc_name string, doc_text string, events array<struct<event_id:string,text:string>>, causal_edges {CAUSAL}, temporal_edges {TEMPORAL}, _corrupt_record string"
LABEL_MAPS = ("labels", "c0_scores", "s_nd_scores", "member_labels", "rank_labels")
LABELS = "doc_id string, removal_sets array<array<string>>, " + ", ".join(f"{n} map<string,double>" for n in LABEL_MAPS)
CHECKPOINT = "source_hash string, run_signature string, last_completed_round int, completed_experts map<string,array<string>>, judge_done boolean"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Readers made inside have some thousand small files in a task: to open one counts as 64 KB, not as 4 MB."""
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 10))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _json(spark: SparkSession, root: str, name: str, schema: str, lines: bool = False) -> DataFrame:
    """One object for each file, or for each line."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("allowNonNumericNumbers", True)
    return reader.json(root).withColumn("path", F.col("_metadata.file_path"))


def read_event_graphs(spark: SparkSession, root: str, name: str = "graph.json", lines: bool = False) -> DataFrame:
    """All files `name` below `root`, with `dir_id` (the folder's name) and `_corrupt_record` for a bad file; or all their `lines`."""
    return _json(spark, root, name, GRAPH, lines).withColumn("dir_id", _folder(F.col("path")))


def graph_nodes(graphs: DataFrame) -> DataFrame:
    """`doc_id`, `pos`, `event_id`, `text`: events with an id; a missing list is empty."""
    rows = graphs.select("doc_id", F.posexplode("events").alias("pos", "e"))
    return rows.where(F.coalesce("e.event_id", F.lit("")) != "").select("doc_id", "pos", "e.event_id", "e.text")


def graph_edges(graphs: DataFrame) -> DataFrame:
    """`doc_id`, `src`, `dst`, `reason`, `edge_type`: edges of both types."""
    causal = graphs.select("doc_id", F.explode("causal_edges").alias("e")).select("doc_id", F.col("e.cause").alias("src"), F.col("e.effect").alias("dst"), "e.reason", F.lit("causal").alias("edge_type"))
    temporal = graphs.select("doc_id", F.explode("temporal_edges").alias("e")).select("doc_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.reason", F.lit("temporal").alias("edge_type"))
    return causal.unionByName(temporal)


def read_source_texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Texts of `*.txt` by the id at the head of the file's name, the first file of an id; and issues: names without id, repeats.

    `folder` may be a pattern of several; each has ids of its own. A file without a byte is an empty text.
    """
    rows = listing.listed(spark, folder, "*.txt", nested=False).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.regexp_extract("path", "^(.*)/", 1).alias("folder"))
    own = F.coalesce("doc_id", "file_name")  # files without id are many in a folder, and none repeats another
    rows = rows.withColumn("doc_id", extract_doc_id("file_name")).withColumn("n", F.row_number().over(Window.partitionBy("folder", own).orderBy("file_name")))
    rows = stored(rows.withColumn("issue", F.when(F.col("doc_id").isNull(), "no id in the name").when(F.col("n") > 1, "repeated id")))
    with small_files(spark):
        docs = listing.contents(rows.where("issue IS NULL"), folder, "*.txt", nested=False)
    return docs.select("doc_id", "file_name", F.col("content").cast("string").alias("text")), rows.where("issue IS NOT NULL").select("file_name", "doc_id", "issue")


def write_named(files: DataFrame, root: str) -> int:
    """Writes each row's `content` (string) to the file `name`, which may have folders, below `root`; returns their number.

    Tasks write by themselves, each file beside its place first and then moved there, so a task that runs again leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{top}/{name}"
                folder = path.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content.encode())
                store.move(beside, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    many = 4 * files.sparkSession.sparkContext.defaultParallelism  # by number, so that small rows aren't merged into few tasks
    return files.select("name", "content").repartition(many).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_document_jsonl(docs: DataFrame, path: str) -> None:
    """One JSON object for each document."""
    docs.write.mode("overwrite").json(path)


def read_document_inputs(spark: SparkSession, folder: str, doc_ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Document JSON files by prefix, number and name, `build_summary.json` aside; the limit is the feature, after the id filter.

    A name that isn't letters and a number alone is its own prefix.
    """
    rows = _json(spark, folder, "*.json", "doc_name string, doc_text string, events map<string,string>").withColumn("stem", _stem(F.col("path"))).where("stem != 'build_summary'")
    parts = F.regexp_extract_all("stem", F.lit(r"^([A-Z]+)[0-9]+$"), 1), F.regexp_extract_all("stem", F.lit(r"^[A-Z]+([0-9]+)$"), 1)
    prefix, number = (F.try_element_at(p, F.lit(1)) for p in parts)
    rows = rows.withColumn("prefix", F.coalesce(prefix, "stem")).withColumn("number", F.coalesce(number.try_cast("decimal(38,0)"), F.lit(NO_NUMBER)))
    if doc_ids is not None:
        rows = rows.where(extract_doc_id("stem").isin(doc_ids))
    rows = rows.orderBy("prefix", "number", "stem")
    return (rows if limit is None else rows.limit(limit)).select("doc_name", "doc_text", "events")


def score_documents(scores: DataFrame) -> DataFrame:
    """One row for each document with its scores as a map: `doc_id`, `scores` (event id to score and rank)."""
    return scores.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("event_id", F.struct("score", "rank")))).alias("scores"))


def read_topology_scores(spark: SparkSession, root: str, name: str = "topology_scores.json", lines: bool = False) -> DataFrame:
    rows = _json(spark, root, name, "doc_id string, num_nodes int, num_edges int, scores map<string,struct<score:double,rank:int>>", lines)
    return rows.select("doc_id", F.explode("scores").alias("event_id", "s")).select("doc_id", "event_id", "s.score", "s.rank")


def read_semantic_scores(spark: SparkSession, root: str, name: str = "semantic_scores.json", lines: bool = False) -> DataFrame:
    rows = _json(spark, root, name, "doc_id string, scores map<string,double>, ranking array<string>, rich_scores map<string,double>, rare_scores map<string,double>", lines)
    long = rows.select("doc_id", "ranking", "rich_scores", "rare_scores", F.explode("scores").alias("event_id", "score"))
    return long.select("doc_id", "event_id", "score", F.expr("array_position(ranking, event_id)").alias("rank"), F.col("rich_scores")[F.col("event_id")].alias("rich"), F.col("rare_scores")[F.col("event_id")].alias("rare"))


def read_labels(spark: SparkSession, root: str, name: str = "*labels.json", lines: bool = False) -> DataFrame:
    """`doc_id`, `event_id` and the five labels of each event."""
    rows = _json(spark, root, name, LABELS, lines)
    return rows.select("doc_id", F.explode(F.map_keys("labels")).alias("event_id"), *LABEL_MAPS).select("doc_id", "event_id", *[F.col(n)[F.col("event_id")].alias(n) for n in LABEL_MAPS])


def read_removal_sets(spark: SparkSession, root: str, name: str = "*labels.json", lines: bool = False) -> DataFrame:
    """`doc_id`, `set_no` from 0, `members` (event ids) of label files."""
    return _json(spark, root, name, LABELS, lines).select("doc_id", F.posexplode("removal_sets").alias("set_no", "members"))


def read_checkpoints(spark: SparkSession, root: str, name: str = "checkpoint.json", lines: bool = False) -> DataFrame:
    """Checkpoints with their completed experts, one row for each; `doc_id` is the folder's name."""
    rows = _json(spark, root, name, CHECKPOINT, lines).withColumn("doc_id", _folder(F.col("path")))
    rows = rows.select("doc_id", "source_hash", "last_completed_round", "judge_done", F.explode_outer("completed_experts").alias("round", "experts"))
    return rows.select("doc_id", "source_hash", "last_completed_round", "judge_done", "round", F.explode_outer("experts").alias("expert"))


def flatten_traces(bundles: DataFrame) -> DataFrame:
    """`doc_id`, `round` from 1, `expert`, `ordinal`, edge: nested rounds (`rounds`: array of experts with edges) as long rows, then the
    judge's kept edges (`judge`)."""
    rounds = bundles.select("doc_id", F.posexplode("rounds").alias("round", "experts")).select("doc_id", (F.col("round") + 1).alias("round"), F.explode("experts").alias("x"))
    rows = rounds.select("doc_id", "round", F.col("x.expert").alias("expert"), F.posexplode("x.edges").alias("ordinal", "edge")).select("doc_id", "round", "expert", "ordinal", "edge.*")
    judge = bundles.select("doc_id", F.lit(None).cast("int").alias("round"), F.lit("judge").alias("expert"), F.posexplode("judge").alias("ordinal", "edge")).select("doc_id", "round", "expert", "ordinal", "edge.*")
    return rows.unionByName(judge)


def run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One row for each run folder: best epoch and loss, latest epoch and train loss; the best falls back to the latest, the train
    loss to the last row of the history, which gives the latest parts of the loss."""
    parts = ("loss_robust", "loss_causal", "loss_total")
    name = "{best_meta,latest_meta,history}.json"  # listed once, and read once
    found = listing.listed(spark, root, name).where("length > 0")
    with small_files(spark):
        rows = listing.contents(found, root, name).withColumn("value", F.col("content").cast("string"))
    known = {"allowNonNumericNumbers": "true"}
    meta = F.from_json("value", "epoch int, val_loss double, best_val_loss double, train_loss double", known)
    history = F.from_json("value", "array<struct<train_loss:double," + ",".join(f"{c}:double" for c in parts) + ">>", known)
    rows = rows.select(_folder(F.col("path")).alias("run"), _stem(F.col("path")).alias("kind"), "value")
    rows = rows.select("run", "kind", F.when(F.col("kind") != "history", meta).alias("m"), F.when(F.col("kind") == "history", F.try_element_at(history, F.lit(-1))).alias("h"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))  # noqa: E731 - a run has one file of a kind
    out = rows.groupBy("run").agg(of("best_meta", F.col("m")).alias("b"), of("latest_meta", F.col("m")).alias("l"), of("history", F.col("h")).alias("h"))
    loss = lambda c: F.coalesce(f"{c}.best_val_loss", f"{c}.val_loss")
    out = out.select("run", F.col("b.epoch").alias("best_epoch"), loss("b").alias("best_loss"), F.col("l.epoch").alias("last_epoch"), loss("l").alias("last_loss"), "l.train_loss", F.col("h.train_loss").alias("history_loss"), *[f"h.{c}" for c in parts])
    return out.select("run", F.coalesce("best_epoch", "last_epoch").alias("best_epoch"), F.coalesce("best_loss", "last_loss").alias("best_loss"), "last_epoch", F.coalesce("train_loss", "history_loss").alias("train_loss"), *parts)
