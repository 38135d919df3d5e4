"""All queries of the library by name, and their SQL. Each query applies one operator to tables that cover all documents."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.storage import shared_folder, stored
from chronoloom.operators import curation, dismantle, evaluate, graphs, incremental, scoring, splits
from chronoloom.operators import documents as prep
from chronoloom.operators.llm_json import parse_llm_json

from chronoloom.sources import files, ledger, tables

from .fixtures import Tables, sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, select: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the derived tables as a query, with its SQL."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if select:
            _SQL[name] = sql(select)
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["ground_truth"](spark, sf_dir)


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


# documents

query("graph_nodes", "SELECT doc_id, event_no - 1 + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS pos, event_id, text FROM nodes")(lambda t: files.graph_nodes(t.graphs).withColumn("pos", F.col("pos").cast("long")))
query("timeline_events", "SELECT doc_id, event_no, event_id FROM nodes")(lambda t: t.nodes.select("doc_id", "event_no", "event_id"))
query("graph_edges", "SELECT doc_id, 'E' || i AS src, 'E' || j AS dst, 'c' || i AS reason, 'causal' AS edge_type FROM causal UNION ALL SELECT doc_id, 'E' || i, 'E' || j, 't' || j, 'temporal' FROM temporal")(lambda t: files.graph_edges(t.graphs))
query("extract_doc_id", "SELECT doc_id, regexp_extract(trim(doc_name), '^([A-Z]+[0-9]+)', 1) AS name_id FROM docs")(lambda t: t.docs.select("doc_id", prep.extract_doc_id(F.concat(F.lit(" "), "doc_name")).alias("name_id")))
query("event_id_num", "SELECT doc_id, event_no, CASE WHEN event_no % 5 = 0 THEN 1000000000 ELSE event_no END AS num FROM nodes")(
    lambda t: t.nodes.select("doc_id", "event_no", prep.event_id_num(F.when(F.col("event_no") % 5 == 0, F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id"))).alias("num"))
)


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.documents.where("doc_id % 7 != 0").select("doc_id", "text"), t.documents.where("doc_id % 5 != 0").select("doc_id", "text")


@query("build_documents", "SELECT d.doc_id AS doc_name, d.text AS doc_text, n.events FROM documents d JOIN (SELECT doc_id, '{' || string_agg(to_json(event_id) || ':' || to_json(text), ',' ORDER BY event_no) || '}' AS events FROM nodes GROUP BY doc_id) n ON n.doc_id = d.doc_id WHERE d.doc_id % 7 <> 0 AND d.doc_id % 5 <> 0")
def build_documents(t: Tables) -> DataFrame:
    return prep.build_documents(*_sides(t)).where("size(events) > 0").select("doc_name", "doc_text", F.to_json("events").alias("events"))


query("build_summary", "SELECT 'cleaned_count' AS what, count(*)::BIGINT AS n, NULL::BIGINT AS doc_id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'timeline_count', count(*), NULL FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'written_docs', count(*), NULL FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT 'missing_in_timeline', 1, doc_id FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT 'missing_in_cleaned', 1, doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0")(
    lambda t: prep.build_summary(*_sides(t)).select("what", "n", F.col("doc_id").cast("long").alias("doc_id"))
)


@query("validate_documents", "SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'blank name' WHEN d.doc_id % 13 = 0 THEN 'blank text' WHEN s.n IS NULL THEN 'no events' WHEN d.doc_id % 17 = 0 THEN 'bad event id' END AS error, coalesce(s.n, 0)::BIGINT AS n_events FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id")
def validate_documents(t: Tables) -> DataFrame:
    named = t.documents.join(prep.events_map(t.nodes.withColumn("event_id", F.when((F.col("doc_id") % 17 == 0) & (F.col("event_no") == 1), "Q1").otherwise(F.col("event_id")))), "doc_id", "left")
    rows = named.select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.col("doc_id").cast("string")).alias("doc_name"), F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("text")).alias("doc_text"), "events")
    return prep.validate_documents(rows, ("doc_id",)).select("doc_id", "error", F.size("event_list").cast("long").alias("n_events"))


query("forward_pairs", "SELECT a.doc_id, a.event_no AS i, b.event_no AS j FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.event_no < b.event_no")(lambda t: prep.forward_pairs(t.nodes))
query("text_list_hash", "SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY event_no)) AS hash FROM nodes GROUP BY doc_id")(lambda t: prep.text_list_hash(t.nodes))
query("source_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")(lambda t: t.documents.select("doc_id", prep.source_hash(F.encode("text", "utf-8")).alias("hash")))
query("estimate_tokens", "SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, ceil(strlen(text) / 3.2::DOUBLE)) END::BIGINT AS n_tokens FROM documents")(lambda t: t.documents.select("doc_id", prep.estimate_tokens("text").alias("n_tokens")))
query("estimate_chat_tokens", "SELECT conv_id, (12 + sum(6 + ceil(strlen(role) / 3.2::DOUBLE) + CASE WHEN strlen(text) = 0 THEN 0 ELSE ceil(strlen(text) / 3.2::DOUBLE) END))::BIGINT AS n_tokens FROM conversations GROUP BY conv_id")(
    lambda t: t.read("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("m")).select("conv_id", prep.estimate_chat_tokens("m").alias("n_tokens"))
)
query("usage_total_tokens", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id + 1 WHEN event_id % 3 = 1 THEN NULLIF(user_id + event_id % 50, 0) END::BIGINT AS n_tokens FROM events")(
    lambda t: t.read("events").select("event_id", prep.usage_total_tokens(F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(0).alias("total_tokens"), F.when(F.col("event_id") % 3 == 1, F.col("user_id")).alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens")))).alias("n_tokens"))
)
query("render_template", "SELECT doc_id, 'Doc ' || doc_name || ' in ' || doc_name || ' #' || doc_id AS body FROM docs")(
    lambda t: t.docs.select("doc_id", prep.render_template(F.lit("Doc {{NAME}} in {{NAME}} #{{ID}}"), {"NAME": F.col("doc_name"), "ID": F.col("doc_id").cast("string")}).alias("body"))
)
_EXPERTS = ", ".join(f"({r}, '{e}', '{role}')" for r, _, e, role in prep.EXPERTS)
_text = lambda x: "'" + x.replace("'", "''") + "'"
_quoted = lambda template, **values: re.sub(r"\{\{(\w+)\}\}", lambda m: f"' || {values[m[1]]} || '", _text(template))
_SHOWN = {"EXPERT": "e.expert", "ROUND": "(e.round + 1)", "ID": "d.doc_id", "NAME": "coalesce(d.doc_name, '')", "EVENTS": "n.events", "DOC": "coalesce(d.text, '')"}
_FREE_SYSTEM = "e.role || " + _text("\n\n" + prep.SCHEMA)
_ASKED = f"docs d JOIN event_lists n ON n.doc_id = d.doc_id, (VALUES {_EXPERTS}) e(round, expert, role)"
query("expert_prompts", f"SELECT d.doc_id, e.round, e.expert, CASE WHEN e.round = 0 THEN {_FREE_SYSTEM} ELSE e.role END AS system_prompt, CASE WHEN e.round = 0 THEN {_quoted(prep.FIRST_USER, **_SHOWN, HISTORY=_text(''))} ELSE {_quoted(prep.LATER_USER, **_SHOWN, CANDIDATES=f'coalesce(c.listed, {_text(prep.NO_CANDIDATES)})')} END AS user_prompt FROM {_ASKED} LEFT JOIN candidates c ON c.doc_id = d.doc_id")(
    lambda t: prep.expert_prompts(t.docs, t.nodes, t.proposals.select("doc_id", "i", "j"))
)
query("expert_prompts_with_history", f"SELECT d.doc_id, e.round, e.expert, {_FREE_SYSTEM} AS system_prompt, {_quoted(prep.FIRST_USER, **_SHOWN, HISTORY='CASE WHEN e.round = 0 OR p.peers IS NULL THEN ' + _text('') + ' ELSE ' + _quoted(prep.HISTORY, OWN=_text(''), PEERS='p.peers') + ' END')} AS user_prompt FROM {_ASKED} LEFT JOIN peers p ON p.doc_id = d.doc_id")(
    lambda t: prep.expert_prompts(t.docs, t.nodes, None, _results(t))
)
query("judge_prompts", f"SELECT d.doc_id, c.n AS n_candidates, {_text(prep.JUDGE)} AS system_prompt, {_quoted(prep.JUDGE_USER, **_SHOWN, CANDIDATES='c.named')} AS user_prompt FROM docs d JOIN event_lists n ON n.doc_id = d.doc_id JOIN candidates c ON c.doc_id = d.doc_id")(lambda t: prep.judge_prompts(t.docs, t.nodes, t.answers))


_SAID = "'\"edge' || o || '\": ' || x"
_ARRAY = "'[\"' || i || '\", \"' || j || '\", \"' || label || '\", \"say {\\\"x\\\"} [\"]'"


@query("parse_llm_json", f"SELECT doc_id, CASE WHEN doc_id % 6 <> 4 THEN '{{' || string_agg({_SAID}, ', ' ORDER BY 'edge' || o) || '}}' WHEN count(*) > 1 THEN min_by(x, 'edge' || o) END AS parsed FROM (SELECT *, {_ARRAY} AS x FROM (SELECT doc_id, i, j, i * 100000 + j AS o, ['no', 'temporal', ' CAUSAL ', 'casual', 'causal'][(doc_id + i + j) % 5 + 1] AS label FROM keys) k) y GROUP BY doc_id")
def parse(t: Tables) -> DataFrame:
    """Answers as models write them: bare, fenced, behind thoughts, inside prose, cut off, with braces in strings."""
    rows = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("edge"), "ordinal"), F.array(F.col("i").cast("string"), F.col("j").cast("string"), "label", F.lit('say {"x"} [')))))))
    said = t.answers.where("expert = 'discourse'").groupBy("doc_id").agg(rows.alias("j"))
    kind = F.col("doc_id") % 6
    raw = F.when(kind == 0, F.col("j")).when(kind == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(kind == 2, F.concat(F.lit("<think>{bad</think>"), "j")).when(kind == 3, F.concat(F.lit("Here: "), "j", F.lit(" done"))).when(kind == 4, F.expr("substring(j, 1, length(j) - 2)")).otherwise(F.concat(F.lit('note "{" '), "j"))
    return said.select("doc_id", parse_llm_json(raw).alias("parsed"))


# files: written below the shared folder and read back


def _lines(df: DataFrame) -> tuple[SparkSession, str]:
    path = shared_folder(df.sparkSession)
    files.write_document_jsonl(df, path)
    return df.sparkSession, path


def _named(t: Tables, *parts: DataFrame) -> str:
    """A new shared folder with the files (name, content) of `parts`."""
    path = shared_folder(t.spark)
    for part in parts:
        files.write_named(part, path)
    return path


def _part() -> Column:
    """The folder of a document's files. A document's name has the first five digits of its id, so the digits behind these are in the folder's
    name, and no two names of a folder are equal; two of the five are as well, so that folders hold a thousand documents."""
    number = F.col("doc_id").cast("string")
    return F.concat(F.lit("p"), F.substring(number, 6, 20), F.lit("_"), F.substring(F.lpad(number, 5, "0"), 1, 2), F.lit("/"))


def _stem() -> Column:
    return F.regexp_replace("doc_name", r"\.txt$", "")


def _texts(t: Tables) -> str:
    """Each document with a language and a source as a file; those of each ninth once more, under a later name; names without an id for each 25th.
    All folders of them, as a pattern."""
    named = t.docs.where("doc_name IS NOT NULL").select("doc_id", "doc_name", F.coalesce("text", F.lit("")).alias("content"))
    again = named.where("doc_id % 9 = 0").select(F.concat(_part(), _stem(), F.lit("_z.txt")).alias("name"), F.concat(F.lit("again "), "content").alias("content"))
    return _named(t, named.select(F.concat(_part(), "doc_name").alias("name"), "content"), again, named.where("doc_id % 25 = 0").select(F.concat(_part(), F.lit("x"), "doc_name").alias("name"), "content")) + "/*"


query("read_source_texts", "SELECT regexp_extract(doc_name, '^([A-Z]+[0-9]+)', 1) AS doc_id, doc_name AS file_name, coalesce(text, '') AS text FROM docs WHERE doc_name IS NOT NULL")(lambda t: files.read_source_texts(t.spark, _texts(t))[0])
query("read_source_texts_issues", "SELECT 'x' || doc_name AS file_name, NULL::VARCHAR AS doc_id, 'no id in the name' AS issue FROM docs WHERE doc_name IS NOT NULL AND doc_id % 25 = 0 UNION ALL SELECT replace(doc_name, '.txt', '_z.txt'), regexp_extract(doc_name, '^([A-Z]+[0-9]+)', 1), 'repeated id' FROM docs WHERE doc_name IS NOT NULL AND doc_id % 9 = 0")(
    lambda t: files.read_source_texts(t.spark, _texts(t))[1]
)


@query("read_document_inputs", "SELECT d.doc_name, d.text AS doc_text, e.events FROM docs d JOIN (SELECT doc_id, '{' || string_agg(to_json(event_id) || ':' || to_json(text), ',' ORDER BY event_no) || '}' AS events FROM nodes GROUP BY doc_id) e ON e.doc_id = d.doc_id WHERE d.doc_name IS NOT NULL")
def read_document_inputs(t: Tables) -> DataFrame:
    """A JSON file for each document with events, and a summary that is none."""
    rows = t.docs.where("doc_name IS NOT NULL").join(prep.events_map(t.nodes), "doc_id")
    summary = t.spark.createDataFrame([("build_summary.json", '{"doc_name": "none"}')], "name string, content string")
    path = _named(t, rows.select(F.concat(_part(), _stem(), F.lit(".json")).alias("name"), F.to_json(F.struct("doc_name", F.col("text").alias("doc_text"), "events")).alias("content")), summary)
    return files.read_document_inputs(t.spark, path).select("doc_name", "doc_text", F.to_json("events").alias("events"))


@query("read_checkpoints", "SELECT d.doc_name AS doc_id, sha256(d.text) AS source_hash, (d.doc_id % 3 - 1)::INT AS last_completed_round, d.doc_id % 4 = 0 AS judge_done, e.round::VARCHAR AS round, e.expert FROM docs d LEFT JOIN (VALUES (0, 'temporal'), (0, 'precondition'), (1, 'discourse')) e(round, expert) ON e.round < d.doc_id % 3 WHERE d.doc_name IS NOT NULL")
def read_checkpoints(t: Tables) -> DataFrame:
    """A folder for each document with its checkpoint: no round, the first one, or both done."""
    done = F.to_json(F.map_from_entries(F.filter(F.array(F.struct(F.lit("0"), F.array(F.lit("temporal"), F.lit("precondition"))), F.struct(F.lit("1"), F.array(F.lit("discourse")))), lambda x: x["col1"].cast("int") < F.col("doc_id") % 3)))
    content = F.concat(F.lit('{"source_hash":"'), F.coalesce(prep.source_hash(F.encode("text", "utf-8")), F.lit("")), F.lit('","last_completed_round":'), (F.col("doc_id") % 3 - 1).cast("string"), F.lit(',"judge_done":'), (F.col("doc_id") % 4 == 0).cast("string"), F.lit(',"completed_experts":'), done, F.lit("}"))
    path = _named(t, t.docs.where("doc_name IS NOT NULL").select(F.concat(_part(), "doc_name", F.lit("/checkpoint.json")).alias("name"), content.alias("content")))
    return files.read_checkpoints(t.spark, path)


@query("run_metrics", "SELECT 'r' || doc_id AS run, CASE WHEN doc_id % 4 = 0 THEN last_epoch ELSE best_epoch END::INT AS best_epoch, CASE WHEN doc_id % 4 = 0 THEN last_loss ELSE best_loss END AS best_loss, last_epoch::INT AS last_epoch, CASE WHEN doc_id % 5 = 0 THEN last_loss + 1 ELSE last_loss + 2 END AS train_loss, last_loss AS loss_robust, last_loss / 2 AS loss_causal, last_loss * 2 AS loss_total FROM (SELECT doc_id, arg_max(score, event_no) AS last_loss, max(event_no) AS last_epoch, min(score) AS best_loss, min(event_no) FILTER (WHERE score = best) AS best_epoch FROM (SELECT *, min(score) OVER (PARTITION BY doc_id) AS best FROM topo) x GROUP BY doc_id) y")
def run_metrics(t: Tables) -> DataFrame:
    """A run for each document: its events are epochs. Some have no best epoch, some no train loss but in the history."""
    epochs = F.array_sort(F.collect_list(F.struct("event_no", "score")))
    rows = t.scores("topo").groupBy("doc_id").agg(epochs.alias("e"), F.min(F.struct("score", "event_no")).alias("best")).withColumn("last", F.element_at("e", -1))
    history = F.to_json(F.transform("e", lambda x: F.struct((x["score"] + 1).alias("train_loss"), x["score"].alias("loss_robust"), (x["score"] / 2).alias("loss_causal"), (x["score"] * 2).alias("loss_total"))))
    latest = F.to_json(F.struct(F.col("last.event_no").alias("epoch"), F.col("last.score").alias("val_loss"), F.when(F.col("doc_id") % 5 != 0, F.col("last.score") + 2).alias("train_loss")))
    best = F.to_json(F.struct(F.col("best.event_no").alias("epoch"), F.col("best.score").alias("best_val_loss")))
    made = lambda name, content: F.struct(F.concat(_part(), F.lit("r"), F.col("doc_id").cast("string"), F.lit(f"/{name}.json")).alias("name"), content.alias("content"))
    every = F.array(made("history", history), made("latest_meta", latest), made("best_meta", F.when(F.col("doc_id") % 4 != 0, best)))
    return files.run_metrics(t.spark, _named(t, rows.select(F.inline(every)).where("content IS NOT NULL")))


def _ledger(t: Tables) -> tuple[str, str, dict[str, int]]:
    """Graphs as files, every tenth of them broken; then every third written again without temporal edges, and refreshed."""
    graph = lambda c: F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "events", "causal_edges", c.alias("temporal_edges")))
    name = F.concat(_part(), F.lit("g"), F.col("doc_id").cast("string"), F.lit("/graph.json")).alias("name")
    rows = stored(t.graphs)  # read twice
    content = graph(F.col("temporal_edges"))
    path = _named(t, rows.select(name, F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("{"), content)).otherwise(content).alias("content")))
    table = shared_folder(t.spark)
    ledger.refresh(t.spark, path, "graph.json", files.GRAPH.removesuffix(", _corrupt_record string"), table)
    files.write_named(rows.where("doc_id % 3 = 0").select(name, graph(F.lit(None).cast(rows.schema["temporal_edges"].dataType)).alias("content")), path)
    return path, table, ledger.refresh(t.spark, path, "graph.json", files.GRAPH.removesuffix(", _corrupt_record string"), table)


@query("refreshed_graphs", "SELECT doc_id, 'E' || i AS src, 'E' || j AS dst, 'c' || i AS reason, 'causal' AS edge_type FROM causal WHERE doc_id % 10 <> 0 OR doc_id % 3 = 0 UNION ALL SELECT doc_id, 'E' || i, 'E' || j, 't' || j, 'temporal' FROM temporal WHERE doc_id % 10 <> 0 AND doc_id % 3 <> 0")
def refreshed_graphs(t: Tables) -> DataFrame:
    return files.graph_edges(ledger.read(t.spark, _ledger(t)[1]).withColumn("doc_id", F.col("doc_id").cast("long")))


query("refreshed_graphs_bad", "SELECT regexp_extract('g' || doc_id, '[0-9]+')::BIGINT AS doc_id FROM sized WHERE doc_id % 10 = 0 AND doc_id % 3 <> 0")(lambda t: ledger.read_bad(t.spark, _ledger(t)[1]).select(F.regexp_extract("path", r"/g(\d+)/graph.json$", 1).cast("long").alias("doc_id")))


_EDGE_LIST = "coalesce((SELECT string_agg(edge, '|' ORDER BY edge) FROM (SELECT {0} AS edge FROM {1} e WHERE e.doc_id = s.doc_id) x), '')"


@query("read_event_graphs", f"SELECT s.doc_id, CASE WHEN s.doc_id % 5 = 0 THEN ' no id|null null id|' ELSE '' END || (SELECT string_agg(event_id || ' ' || text, '|' ORDER BY event_no) FROM nodes n WHERE n.doc_id = s.doc_id) AS events, {_EDGE_LIST.format(chr(39) + 'E' + chr(39) + ' || i || ' + chr(39) + ' E' + chr(39) + ' || j || ' + chr(39) + ' c' + chr(39) + ' || i', 'causal')} AS causal, {_EDGE_LIST.format(chr(39) + 'E' + chr(39) + ' || i || ' + chr(39) + ' E' + chr(39) + ' || j || ' + chr(39) + ' t' + chr(39) + ' || j', 'temporal')} AS temporal, NULL AS bad FROM sized s UNION ALL SELECT NULL, NULL, NULL, NULL, '{{\"doc_id\": \"1\", \"events\": [broken' FROM documents WHERE doc_id % 50 = 0")
def read_event_graphs(t: Tables) -> DataFrame:
    """Graphs as JSON lines, and a broken line for each fiftieth document; their lists are shown as text."""
    path = shared_folder(t.spark)
    lines = t.graphs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "events", "causal_edges", "temporal_edges")).alias("value"))
    lines.union(t.documents.where("doc_id % 50 = 0").select(F.lit('{"doc_id": "1", "events": [broken'))).write.text(path)
    bad = F.col("_corrupt_record").isNotNull()
    shown = lambda c, *parts: F.transform(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)), lambda e: F.concat_ws(" ", *[F.coalesce(e[p], F.lit("null")) for p in parts]))
    rows = files.read_event_graphs(t.spark, path, "*.txt", True)
    columns = {"events": F.array_join(shown("events", "event_id", "text"), "|"), "causal": F.array_join(F.array_sort(shown("causal_edges", "cause", "effect", "reason")), "|"), "temporal": F.array_join(F.array_sort(shown("temporal_edges", "source", "target", "reason")), "|")}
    return rows.select(F.when(~bad, F.col("doc_id").cast("long")).alias("doc_id"), *[F.when(~bad, c).alias(n) for n, c in columns.items()], F.col("_corrupt_record").alias("bad"))


@query("write_document_jsonl", "SELECT d.doc_id, d.text AS doc_text, n.events FROM documents d JOIN (SELECT doc_id, '{' || string_agg(to_json(event_id) || ':' || to_json(text), ',' ORDER BY event_no) || '}' AS events FROM nodes GROUP BY doc_id) n ON n.doc_id = d.doc_id")
def write_document_jsonl(t: Tables) -> DataFrame:
    spark, path = _lines(prep.build_documents(t.documents.select("doc_id", "text"), t.documents.select("doc_id", "text")).where("size(events) > 0"))
    rows = spark.read.schema("doc_name long, doc_text string, events map<string,string>").json(path)
    return rows.select(F.col("doc_name").alias("doc_id"), "doc_text", F.to_json("events").alias("events"))


@query("read_topology_scores", "SELECT doc_id, event_id, score, rank FROM topo_ranked")
def read_topology_scores(t: Tables) -> DataFrame:
    spark, path = _lines(files.score_documents(scoring.unique_rank(t.scores("topo"))))
    return files.read_topology_scores(spark, path, "*.json", True).select(F.col("doc_id").cast("long").alias("doc_id"), "event_id", "score", F.col("rank").cast("long").alias("rank"))


@query("read_semantic_scores", "SELECT doc_id, event_id, score, rank, score * 2 AS rich, CASE WHEN event_no % 2 = 0 THEN 0.5::DOUBLE END AS rare FROM sem_ranked")
def read_semantic_scores(t: Tables) -> DataFrame:
    ranked = scoring.semantic_ranking(t.scores("sem"))
    entries = lambda value, keep: F.map_from_entries(F.filter(F.collect_list(F.when(keep, F.struct("event_id", value))), lambda e: e.isNotNull()))
    ranking = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda e: e["event_id"])
    spark, path = _lines(ranked.groupBy("doc_id").agg(entries(F.col("score"), F.lit(True)).alias("scores"), ranking.alias("ranking"), entries(F.col("score") * 2, F.lit(True)).alias("rich_scores"), entries(F.lit(0.5), F.col("event_no") % 2 == 0).alias("rare_scores")))
    return files.read_semantic_scores(spark, path, "*.json", True).select(F.col("doc_id").cast("long").alias("doc_id"), "event_id", "score", F.col("rank").cast("long").alias("rank"), "rich", "rare")


def _label_files(t: Tables) -> tuple[SparkSession, str]:
    maps = [F.map_from_entries(F.collect_list(F.struct("event_id", (F.col("score") + k).alias("v")))).alias(n) for k, n in enumerate(files.LABEL_MAPS)]
    sets = F.transform(F.array_sort(F.collect_list(F.struct("set_no", "members"))), lambda s: F.transform(s["members"], lambda m: F.concat(F.lit("E"), m.cast("string"))))
    rows = t.scores("topo").groupBy("doc_id").agg(*maps).join(t.removal_sets.groupBy("doc_id").agg(sets.alias("removal_sets")), "doc_id", "left")
    return _lines(rows)


query("read_labels", "SELECT doc_id, event_id, score AS labels, score + 1 AS c0_scores, score + 2 AS s_nd_scores, score + 3 AS member_labels, score + 4 AS rank_labels FROM topo")(lambda t: files.read_labels(*_label_files(t), "*.json", True).withColumn("doc_id", F.col("doc_id").cast("long")))
query("read_removal_sets", "SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.set_no) - 1 AS set_no, s.members FROM (SELECT doc_id, set_no, string_agg('E' || event_no, ',' ORDER BY event_no) AS members FROM set_members GROUP BY doc_id, set_no) s WHERE s.doc_id IN (SELECT doc_id FROM topo)")(
    lambda t: files.read_removal_sets(*_label_files(t), "*.json", True).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("set_no").cast("long").alias("set_no"), F.array_join("members", ",").alias("members"))
)


@query("flatten_traces", "SELECT doc_id, 1::BIGINT AS round, expert, i, j, row_number() OVER (PARTITION BY doc_id, expert ORDER BY i, j) - 1 AS ordinal FROM proposals UNION ALL SELECT doc_id, 2, expert, i, j, row_number() OVER (PARTITION BY doc_id, expert ORDER BY i, j) - 1 FROM classified WHERE kind = 'causal' UNION ALL SELECT doc_id, NULL, 'judge', i, j, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 FROM verdicts WHERE verdict = 'kept'")
def flatten_traces(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("i", "j")))
    said = _results(t).where("kind = 'causal'").groupBy("doc_id", "round", "expert").agg(listed.alias("edges"))
    rounds = said.groupBy("doc_id").agg(*[F.collect_list(F.when(F.col("round") == r, F.struct("expert", "edges"))).alias(f"r{r}") for r in (0, 1)])
    judge = _verdicts(t).where("verdict = 'kept'").groupBy("doc_id").agg(listed.alias("judge"))
    bundles = rounds.select("doc_id", F.array("r0", "r1").alias("rounds")).join(judge, "doc_id", "left")
    return files.flatten_traces(bundles).select("doc_id", F.col("round").cast("long").alias("round"), "expert", "i", "j", F.col("ordinal").cast("long").alias("ordinal"))


# curation

_KNOWN = list(curation.KNOWN_EXPERTS)[:2]


def _supporters() -> Column:
    """Two known experts and two unknown ones, unknown ones alone, or none at all, by the events' numbers."""
    kind = (prep.event_id_num(prep.strip("cause")) + prep.event_id_num(prep.strip("effect"))) % 3
    return F.when(kind == 0, F.array(F.lit("nobody"), *[F.lit(x) for x in _KNOWN], F.lit(""))).when(kind == 1, F.array(F.lit("nobody")))


query("normalize_edges", "SELECT p.*, CASE WHEN (i + j) % 3 = 0 THEN 'discourse,judge' WHEN (i + j) % 3 = 1 THEN '' END AS supporters FROM (SELECT doc_id, expert, i, j, ordinal, 'because ' || i || '-' || j AS reason FROM proposals UNION ALL SELECT doc_id, expert, i, j, ordinal + 1000000000, 'because ' || i || '-' || j FROM proposals WHERE doc_id % 10 = 0) p".replace("discourse,judge", ",".join(_KNOWN)))(
    lambda t: curation.normalize_edges(t.raw_proposals.withColumn("supporters", _supporters()), t.nodes).select("doc_id", "expert", "i", "j", "ordinal", "reason", F.array_join("supporters", ",").alias("supporters"))
)
query("dedupe_edges", "SELECT doc_id, expert, i, j, row_number() OVER (PARTITION BY doc_id, expert ORDER BY i, j)::BIGINT AS rank FROM proposals")(lambda t: curation.dedupe_edges(curation.normalize_edges(t.raw_proposals, t.nodes), ("expert",)).select("doc_id", "expert", "i", "j", "rank"))


@query("normalize_proposals", "SELECT doc_id, expert, i, j, row_number() OVER (PARTITION BY doc_id, expert ORDER BY ordinal) - 1 AS ordinal FROM proposals")
def normalize_proposals(t: Tables) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "i", "j"))), lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j")))
    said = t.proposals.groupBy("doc_id", "expert").agg(rows.alias("rows"))
    even = F.col("doc_id") % 2 == 0
    return curation.normalize_proposals(said.select("doc_id", "expert", F.when(even, F.col("rows")).alias("edges"), F.when(~even, F.col("rows")).alias("causal_edges"))).select("doc_id", "expert", "i", "j", "ordinal")


def _classified(t: Tables) -> DataFrame:
    return curation.classify_proposals(t.answers, t.proposals)


def _pool(t: Tables) -> DataFrame:
    rows = _classified(t).where("kind = 'causal'")
    return curation.candidate_pool(rows.withColumn("expert_no", F.when(F.col("expert") == "discourse", 2).otherwise(3)))


def _verdicts(t: Tables) -> DataFrame:
    return curation.judge_verdicts(t.verdict_rows, _pool(t))


query("classify_proposals", "SELECT doc_id, expert, i, j, kind, 'because ' || i || '-' || j AS reason, i * 100000 + j AS ordinal FROM classified")(lambda t: _classified(t))
query("candidate_pool", "SELECT doc_id, i, j, supporters, n_supporters, replace(supporters, ',', ': because ' || i || '-' || j || '|') || ': because ' || i || '-' || j AS reasons FROM pool")(
    lambda t: _pool(t).select("doc_id", "i", "j", F.array_join("supporters", ",").alias("supporters"), "n_supporters", F.array_join(F.transform("reasons", lambda r: F.concat(r["expert"], F.lit(": "), r["reason"])), "|").alias("reasons"))
)
query("allowed_keys", "SELECT doc_id, i, j FROM keys")(lambda t: curation.allowed_keys(t.proposals))
query("experts_agree", "SELECT k.doc_id, coalesce(bool_and(n = 2), true) AS agreed FROM (SELECT DISTINCT doc_id FROM keys) k LEFT JOIN (SELECT doc_id, i, j, count(*) AS n FROM classified WHERE kind = 'causal' GROUP BY ALL) c ON c.doc_id = k.doc_id GROUP BY k.doc_id")(
    lambda t: curation.experts_agree(_classified(t), t.answers.select("doc_id", "expert"))
)
query("judge_verdicts", "SELECT doc_id, i, j, verdict, reason, supporters FROM verdicts")(lambda t: _verdicts(t).withColumn("supporters", F.array_join("supporters", ",")))
query("llm_temporal_edges", "SELECT doc_id, i, j, min(p)::BIGINT AS priority, j - i AS span, arg_min(reason, p) AS reason FROM (SELECT doc_id, i, j, 0 AS p, reason FROM verdicts WHERE verdict = 'temporal' UNION ALL SELECT doc_id, i, j, CASE WHEN expert = 'discourse' THEN 1 ELSE 2 END, 'because ' || i || '-' || j FROM classified WHERE kind = 'temporal') x GROUP BY doc_id, i, j")(
    lambda t: curation.llm_temporal_edges(_verdicts(t), _classified(t))
)
query("merge_edge_types", "SELECT doc_id, i, j FROM edges")(lambda t: curation.merge_edge_types(t.causal, t.temporal, t.nodes))
query("typed_edges", "SELECT doc_id, src, dst, rel FROM typed")(lambda t: curation.typed_edges(t.causal, t.temporal))


def _results(t: Tables) -> DataFrame:
    first = t.proposals.select("doc_id", F.lit(0).alias("round"), "expert", F.lit("causal").alias("kind"), "i", "j", "reason")
    return first.unionByName(_classified(t).select("doc_id", F.lit(1).alias("round"), "expert", "kind", "i", "j", "reason"))


def _presence(t: Tables) -> DataFrame:
    experts = F.array(*[F.struct(F.lit(r).alias("round"), F.lit(no).alias("expert_no"), F.lit(e).alias("expert")) for r, no, e, _ in prep.EXPERTS])
    return t.documents.select("doc_id", F.inline(experts))


_LINES = "string_agg('- E' || i || ' -> E' || j || '  ' || reason, chr(10) ORDER BY i, j) AS lines"
query("discussion_summary", f"""SELECT d.doc_id, 'Document: ' || d.doc_name || CASE WHEN d.body <> '' THEN chr(10) || chr(10) || '===== Text =====' || chr(10) || chr(10) || d.body ELSE '' END || chr(10) || p.parts AS summary
FROM (SELECT doc_id, doc_name, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM docs) d JOIN (SELECT doc_id, string_agg(part, chr(10) ORDER BY round, no, kind) AS parts FROM (
  SELECT a.doc_id, a.round, a.no, a.kind, '[' || a.expert || '] ' || a.kind || ' edges' || chr(10) || coalesce(s.lines, '- none') AS part FROM (SELECT doc_id, e.* FROM documents, (VALUES (0, 0, 'temporal', 'causal'), (0, 1, 'precondition', 'causal'), (1, 2, 'discourse', 'causal'), (1, 2, 'discourse', 'temporal'), (1, 3, 'commonsense', 'causal'), (1, 3, 'commonsense', 'temporal')) e(round, no, expert, kind)) a
  LEFT JOIN (SELECT doc_id, expert, kind, {_LINES} FROM (SELECT doc_id, expert, 'causal' AS kind, i, j, 'because ' || i || '-' || j AS reason FROM proposals UNION ALL SELECT doc_id, expert, kind, i, j, 'because ' || i || '-' || j FROM classified) q GROUP BY ALL) s ON s.doc_id = a.doc_id AND s.expert = a.expert AND s.kind = a.kind
  UNION ALL SELECT doc_id, r, -1, '', chr(10) || 'Round ' || (r + 1) FROM documents, (VALUES (0), (1)) v(r)
  UNION ALL SELECT a.doc_id, 1000000, 0, a.kind, 'Judge ' || a.kind || ' edges' || chr(10) || coalesce(s.lines, '- none') FROM (SELECT doc_id, k.kind FROM documents, (VALUES ('causal'), ('temporal')) k(kind)) a
  LEFT JOIN (SELECT doc_id, CASE WHEN verdict = 'kept' THEN 'causal' ELSE 'temporal' END AS kind, {_LINES} FROM verdicts WHERE verdict IN ('kept', 'temporal') GROUP BY ALL) s ON s.doc_id = a.doc_id AND s.kind = a.kind) x GROUP BY doc_id) p ON p.doc_id = d.doc_id""")(
    lambda t: curation.discussion_summary(t.docs, _results(t), _presence(t), _verdicts(t))
)
query("document_status", "SELECT d.doc_id, CASE WHEN v.n_pool IS NULL THEN 'empty_pool' WHEN e.n_final IS NULL THEN 'no_edges' ELSE 'done' END AS status, coalesce(n_pool, 0)::BIGINT AS n_pool, coalesce(n_kept, 0)::BIGINT AS n_kept, coalesce(n_final, 0)::BIGINT AS n_final FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_pool, count(*) FILTER (WHERE verdict = 'kept') AS n_kept FROM verdicts GROUP BY doc_id) v ON v.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n_final FROM edges GROUP BY doc_id) e ON e.doc_id = d.doc_id")(
    lambda t: curation.document_status(t.documents, _verdicts(t), t.edges)
)

# temporal repair

MIN_SIM = 0.2
query("pair_similarity", "SELECT doc_id, i, j, round(sim, 6) AS sim FROM pair_sims")(lambda t: graphs.pair_similarity(t.vectors).withColumn("sim", F.round("sim", 6)))
query("similarity_candidates", f"SELECT doc_id, i, j, round(sim, 6) AS sim, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 6) DESC, j - i, i)::BIGINT AS rank FROM pair_sims WHERE sim >= {MIN_SIM}")(
    lambda t: graphs.similar_pairs(t.vectors, MIN_SIM)
)


@query("add_temporal_edges")
def add_temporal_edges(t: Tables) -> DataFrame:
    sims = stored(graphs.pair_similarity(t.vectors))  # read several times
    return graphs.add_temporal_edges(t.causal, curation.llm_temporal_edges(_verdicts(t), _classified(t)), graphs.similarity_candidates(sims, MIN_SIM), sims)


@query("complete_temporal")
def complete_temporal(t: Tables) -> DataFrame:
    sims = stored(graphs.pair_similarity(t.vectors))  # read several times
    return graphs.complete_temporal(t.nodes, t.causal, curation.llm_temporal_edges(_verdicts(t), _classified(t)), graphs.similarity_candidates(sims, MIN_SIM), sims)


query("transitive_reduction", "SELECT t.doc_id, t.i, t.j FROM temporal t WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN closure c ON c.doc_id = e.doc_id AND c.i = e.j WHERE e.doc_id = t.doc_id AND e.i = t.i AND c.j = t.j)")(lambda t: graphs.transitive_reduction(t.causal, t.temporal))
query("connect_isolated", "SELECT doc_id, i, j FROM (SELECT n.doc_id, CASE WHEN n.event_no = 1 THEN 1 ELSE n.event_no - 1 END AS i, CASE WHEN n.event_no = 1 THEN 2 ELSE n.event_no END AS j FROM degree n JOIN sized s ON s.doc_id = n.doc_id WHERE n.in_degree + n.out_degree = 0 AND s.n > 1) x GROUP BY doc_id, i, j")(lambda t: graphs.connect_isolated(t.nodes, t.edges))
query("connected_components", "SELECT doc_id, event_no, component, min(component) OVER (PARTITION BY doc_id) = max(component) OVER (PARTITION BY doc_id) AS all_connected FROM component")(lambda t: graphs.connected_components(t.nodes, t.edges))
query("bridge_components", "SELECT DISTINCT doc_id, 1::BIGINT AS i, component AS j FROM component WHERE component > 1")(lambda t: graphs.bridge_components(t.nodes, t.edges))
#: All forward pairs of a document, however far apart, and each event with itself.
query("path_exists", "SELECT a.doc_id, a.event_no AS s, b.event_no AS t, a.event_no = b.event_no OR c.i IS NOT NULL AS found FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.event_no <= b.event_no LEFT JOIN closure c ON c.doc_id = a.doc_id AND c.i = a.event_no AND c.j = b.event_no")(
    lambda t: graphs.path_exists(graphs.reachable_pairs(t.edges), prep.forward_pairs(t.nodes).select("doc_id", F.col("i").alias("s"), F.col("j").alias("t")).unionByName(t.nodes.select("doc_id", F.col("event_no").alias("s"), F.col("event_no").alias("t"))))
)

# features

query("graph_sizes", "SELECT s.doc_id, s.n AS n_nodes, coalesce(e.c, 0)::BIGINT AS n_edges, coalesce(a.c, 0)::BIGINT AS n_causal, coalesce(b.c, 0)::BIGINT AS n_temporal FROM sized s LEFT JOIN (SELECT doc_id, count(*) c FROM edges GROUP BY 1) e USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) c FROM causal GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) c FROM temporal GROUP BY 1) b USING (doc_id)")(lambda t: graphs.graph_sizes(t.nodes, t.causal, t.temporal))
query("degrees", "SELECT doc_id, event_no, in_degree, out_degree, in_degree + out_degree AS degree FROM degree")(lambda t: graphs.degrees(t.nodes, t.edges))
query("two_hop_counts", "SELECT doc_id, event_no, pred_two_hop, succ_two_hop FROM hops")(lambda t: graphs.two_hop_counts(t.nodes, t.edges))
query("three_hop_counts", "SELECT doc_id, event_no, pred_three_hop, succ_three_hop FROM hops")(lambda t: graphs.three_hop_counts(t.nodes, t.edges))
query("reach_local_proxy", "SELECT doc_id, event_no, pred_two_hop * succ_two_hop AS reach_local_proxy FROM hops")(lambda t: graphs.reach_local_proxy(graphs.two_hop_counts(t.nodes, t.edges)))
query("sole_counts", "SELECT doc_id, event_no, succ_sole_count, pred_sole_count FROM side_sums")(lambda t: graphs.sole_counts(t.nodes, t.edges, graphs.degrees(t.nodes, t.edges)))
query("inv_degree_sums", "SELECT doc_id, event_no, round(pred_inv_degree_sum, 6) AS pred_inv_degree_sum, round(succ_inv_degree_sum, 6) AS succ_inv_degree_sum FROM side_sums")(
    lambda t: graphs.inv_degree_sums(t.nodes, t.edges, graphs.degrees(t.nodes, t.edges)).select("doc_id", "event_no", r6("pred_inv_degree_sum"), r6("succ_inv_degree_sum"))
)


def _scaled(c: str) -> str:
    low, high = (f"{f}({c}) OVER (PARTITION BY doc_id)" for f in ("min", "max"))
    return f"round(CASE WHEN abs({high} - {low}) <= 1e-9 * greatest(abs({high}), abs({low})) THEN 0 ELSE ({c} - {low}) / ({high} - {low})::DOUBLE END, 6) AS {c}"


query("node_features", f"SELECT doc_id, event_no, {', '.join(_scaled(c) for c in graphs.FEATURES)} FROM features")(lambda t: graphs.node_features(t.nodes, t.edges).select("doc_id", "event_no", *[r6(c) for c in graphs.FEATURES]))
query("minmax_by_doc", f"SELECT doc_id, event_no, {_scaled('score')} FROM topo")(lambda t: graphs.minmax_by_doc(t.scores("topo"), ["score"]).select("doc_id", "event_no", r6("score")))
query("reachable_pairs", "SELECT doc_id, i, j FROM closure")(lambda t: graphs.reachable_pairs(t.edges))
query("reachable_counts", "SELECT s.doc_id, coalesce(c.c, 0)::BIGINT AS n_pairs FROM sized s LEFT JOIN (SELECT doc_id, count(*) c FROM closure GROUP BY 1) c USING (doc_id)")(lambda t: graphs.reachable_counts(t.nodes, graphs.reachable_pairs(t.edges)))
#: Every event is an anchor.
query("lineage", "SELECT doc_id, i AS anchor, j AS event_no, 'descendant' AS side FROM closure UNION ALL SELECT doc_id, j, i, 'ancestor' FROM closure UNION ALL SELECT doc_id, event_no, event_no, s.side FROM nodes, (VALUES ('descendant'), ('ancestor')) s(side)")(
    lambda t: graphs.lineage(graphs.reachable_pairs(t.edges), t.nodes.select("doc_id", F.col("event_no").alias("anchor")))
)

# dismantling

_SETS = "SELECT doc_id, set_no, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN a::VARCHAR ELSE a || ',' || b END AS members, k, original_pairs, final_pairs FROM least_sets"
query("ground_truth_sets", _SETS)(lambda t: dismantle.ground_truth(t.nodes, t.edges)[1].select("doc_id", "set_no", F.array_join("members", ",").alias("members"), "k", "original_pairs", "final_pairs"))
query("ground_truth_stats", "SELECT doc_id, max(k) AS k, max(original_pairs) AS original_pairs, max(final_pairs) AS final_pairs, count(*) FILTER (WHERE k > 0) AS n_sets FROM least_sets GROUP BY doc_id")(lambda t: dismantle.ground_truth(t.nodes, t.edges)[2])
query("minimal_removal_sets", "SELECT doc_id, set_no, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN a::VARCHAR ELSE a || ',' || b END AS members, k, original_pairs, final_pairs FROM least_sets")(lambda t: dismantle.minimal_removal_sets(t.nodes, t.edges).select("doc_id", "set_no", F.array_join("members", ",").alias("members"), "k", "original_pairs", "final_pairs"))
query("greedy_removal")(lambda t: dismantle.greedy_removal(t.nodes, t.edges))
query("removal_frequency", "SELECT doc_id, event_no, c0 FROM c0")(lambda t: dismantle.removal_frequency(t.nodes, t.removal_sets))
query("member_labels", "SELECT doc_id, event_no, CASE WHEN c0 > 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS member FROM c0")(lambda t: dismantle.member_labels(dismantle.removal_frequency(t.nodes, t.removal_sets)).select("doc_id", "event_no", "member"))
query("neighbor_propagation", "SELECT doc_id, event_no, round(s_nd, 6) AS s_nd FROM s_nd")(lambda t: dismantle.neighbor_propagation(t.edges, dismantle.removal_frequency(t.nodes, t.removal_sets)).select("doc_id", "event_no", r6("s_nd")))


def _shares(c0: str, s_nd: str) -> str:
    """SQL of each event's share of its tier, `m` its members, by labels in two tables."""
    return f"SELECT *, (rank() OVER (PARTITION BY doc_id, m ORDER BY round(CASE WHEN m THEN c0 ELSE s_nd END, 9), d, CASE WHEN m THEN p ELSE 0 END))::DOUBLE / count(*) OVER (PARTITION BY doc_id, m) AS share FROM (SELECT c.doc_id, c.event_no, c.c0 > 1e-9 AS m, c.c0, s.s_nd, g.in_degree + g.out_degree AS d, h.pred_two_hop * h.succ_two_hop AS p FROM {c0} c JOIN {s_nd} s USING (doc_id, event_no) JOIN degree g USING (doc_id, event_no) JOIN hops h USING (doc_id, event_no)) x"


_MEMBER = "CASE WHEN m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS member"
_RANK_LABEL = "round(CASE WHEN m THEN 0.7 + 0.3 * share ELSE 0.3 * share END, 6) AS rank_label"


@query("tier_rank_labels", f"SELECT doc_id, event_no, {_RANK_LABEL} FROM ({_shares('c0', 's_nd')}) y")
def tier_rank_labels(t: Tables) -> DataFrame:
    rows = dismantle.neighbor_propagation(t.edges, dismantle.removal_frequency(t.nodes, t.removal_sets))
    return dismantle.tier_rank_labels(rows).select("doc_id", "event_no", r6("rank_label"))


query("ground_truth", f"SELECT doc_id, event_no, round(c0, 6) AS c0, round(s_nd, 6) AS s_nd, {_MEMBER}, {_RANK_LABEL} FROM ({_shares('least_c0', 'least_s_nd')}) y")(lambda t: dismantle.ground_truth(t.nodes, t.edges)[0].select("doc_id", "event_no", r6("c0"), r6("s_nd"), "member", r6("rank_label")))

# tables of results: written, written again for some documents, and read back


def _rerun(t: Tables, rows: DataFrame, changed: DataFrame) -> DataFrame:
    """`rows`; then those of every third document again, as `changed`; then every seventh document without rows."""
    path = shared_folder(t.spark)
    tables.write(rows, path)
    tables.write(changed.where("doc_id % 3 = 0"), path)
    tables.write(changed.where("doc_id % 7 = 0").limit(0), path, documents=t.documents.where("doc_id % 7 = 0"))
    return tables.read(t.spark, path)


@query("write_graph_table", "SELECT doc_id, i, j, edge_type, reason, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE 'first' END AS run FROM review_old WHERE doc_id % 7 <> 0")
def write_graph_table(t: Tables) -> DataFrame:
    return _rerun(t, t.review_old.withColumn("run", F.lit("first")), t.review_old.withColumn("run", F.lit("again")))


def _labels_of(t: Tables) -> DataFrame:
    rows = dismantle.neighbor_propagation(t.edges, dismantle.removal_frequency(t.nodes, t.removal_sets))
    return dismantle.tier_rank_labels(rows).select("doc_id", "event_no", r6("c0"), r6("s_nd"), "member", r6("rank_label"))


@query("write_labels", f"SELECT doc_id, event_no, round(c0, 6) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS c0, round(s_nd, 6) AS s_nd, {_MEMBER}, {_RANK_LABEL} FROM ({_shares('c0', 's_nd')}) y WHERE doc_id % 7 <> 0")
def write_labels(t: Tables) -> DataFrame:
    rows = stored(_labels_of(t))
    return _rerun(t, rows, rows.withColumn("c0", F.col("c0") + 1))


@query("write_features", f"SELECT doc_id, event_no, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::INT AS run, {', '.join(_scaled(c) for c in graphs.FEATURES)} FROM features WHERE doc_id % 7 <> 0")
def write_features(t: Tables) -> DataFrame:
    rows = stored(graphs.node_features(t.nodes, t.edges).select("doc_id", "event_no", *[r6(c) for c in graphs.FEATURES]))
    return _rerun(t, rows.withColumn("run", F.lit(1)), rows.withColumn("run", F.lit(2)))


@query("write_scores", "SELECT doc_id, event_no, event_id, CASE WHEN doc_id % 3 = 0 THEN -score ELSE score END AS score, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 3 = 0 THEN -score ELSE score END DESC, event_id)::BIGINT AS rank FROM topo WHERE doc_id % 7 <> 0")
def write_scores(t: Tables) -> DataFrame:
    """Ranked scores, then others of some documents; what is read back needs no shuffle to be ranked by document."""
    rows = t.scores("topo")
    return scoring.unique_rank(_rerun(t, rows, rows.withColumn("score", -F.col("score"))))


# splits

BANDS = "CASE WHEN n < 3 THEN 'skipped' WHEN n <= 30 THEN 'labeled' ELSE 'inference_only' END"


def _sizes(t: Tables) -> DataFrame:
    return t.sized.withColumnRenamed("n", "n_nodes")


query("size_bands", f"SELECT doc_id, n AS n_nodes, {BANDS} AS band, n >= 3 AS scored FROM sized")(lambda t: splits.size_bands(_sizes(t)))
query("train_test_split", "SELECT doc_id, split FROM split")(lambda t: splits.train_test_split(_sizes(t)))
query("kfold", "SELECT doc_id, (ntile(4) OVER (ORDER BY md5('42:' || doc_id)) - 1)::BIGINT AS fold FROM sized")(lambda t: splits.kfold(_sizes(t), 4))
_MANIFEST = f"SELECT b.doc_id, b.n_nodes, b.band, CASE WHEN b.band <> 'labeled' THEN b.band WHEN s.doc_id IS NULL THEN 'failed' WHEN s.r <= greatest(1, round_even(s.c * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, n AS n_nodes, {BANDS} AS band FROM sized) b LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, count(*) OVER () AS c FROM sized WHERE n BETWEEN 3 AND 30 AND doc_id % 9 <> 0 AND doc_id % 8 <> 0) s ON s.doc_id = b.doc_id"


def _manifest(t: Tables) -> tuple[DataFrame, DataFrame]:
    return splits.split_manifest(_sizes(t), t.documents.where("doc_id % 9 != 0"), t.documents.where("doc_id % 8 = 0"))


query("split_manifest", _MANIFEST)(lambda t: _manifest(t)[0])
query("split_manifest_counts", f"SELECT split, count(*) AS n FROM ({_MANIFEST}) x GROUP BY split")(lambda t: _manifest(t)[1])


def _samples(t: Tables) -> tuple[DataFrame, DataFrame]:
    f = t.scores("topo").where("doc_id % 8 != 0").select("doc_id", "event_no", F.col("score").alias("f"))
    labels = t.scores("sem").where("doc_id % 9 != 0").select("doc_id", "event_no", F.col("score").alias("label"))
    return splits.assemble_samples(f, labels, t.edges, t.sized)


query("assemble_samples", "SELECT n.doc_id, n.event_no, t.score AS f, s.score AS label FROM nodes n JOIN topo t USING (doc_id, event_no) JOIN sem s USING (doc_id, event_no) WHERE n.doc_id % 9 <> 0 AND n.doc_id % 8 <> 0 AND EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = n.doc_id)")(lambda t: _samples(t)[0].select("doc_id", "event_no", "f", "label"))
query("assemble_samples_rejects", "SELECT * FROM (SELECT s.doc_id, CASE WHEN s.doc_id % 9 = 0 OR s.doc_id NOT IN (SELECT doc_id FROM sem) THEN 'no labels' WHEN s.doc_id % 8 = 0 OR s.doc_id NOT IN (SELECT doc_id FROM topo) THEN 'no features' WHEN s.doc_id NOT IN (SELECT doc_id FROM edges) THEN 'no graph' END AS reason FROM sized s) x WHERE reason IS NOT NULL")(lambda t: _samples(t)[1])
query("attach_vectors_missing", "SELECT doc_id FROM sized WHERE doc_id % 10 = 0")(lambda t: splits.attach_vectors(t.nodes, t.vectors.where("doc_id % 10 != 0"))[1])
query("attach_vectors", "SELECT doc_id, event_no, event_id, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',') AS vector FROM nodes JOIN vectors USING (doc_id, event_no)")(
    lambda t: splits.attach_vectors(t.nodes, t.vectors)[0].select("doc_id", "event_no", "event_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long")), ",").alias("vector"))
)
U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
query("drop_edges_by_type", f"SELECT doc_id, src, dst, rel FROM typed WHERE {U.format(chr(39) + '42:v2:' + chr(39) + ' || doc_id || ' + chr(39) + ':' + chr(39) + ' || src || ' + chr(39) + ':' + chr(39) + ' || dst || ' + chr(39) + ':' + chr(39) + ' || rel')} >= CASE WHEN rel <= 1 THEN 0.6 ELSE 0.1 END")(
    lambda t: splits.drop_edges_by_type(curation.typed_edges(t.causal, t.temporal), {0: 0.6, 1: 0.6, 2: 0.1, 3: 0.1}, 42, "v2")
)
_MASKED = U.format("'42:v1a:' || doc_id || ':' || event_no || ':' || k")
_GONE = "array_to_string(list_filter(range(0, len(embedding)), lambda k: embedding[k + 1] = 0 OR {} < {}), ',') AS masked, round(list_sum(list_transform(range(0, len(embedding)), lambda k: CASE WHEN {} < {} THEN 0 ELSE embedding[k + 1]::DOUBLE END)), 5) AS total"
_masked = lambda df: df.withColumn("masked", F.array_join(F.filter(F.transform("embedding", lambda x, k: F.when(x == 0, k)), lambda k: k.isNotNull()), ",")).withColumn("total", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5)).drop("embedding")
query("mask_vectors", f"SELECT doc_id, event_no, {_GONE.format(_MASKED, 0.15, _MASKED, 0.15)} FROM vectors")(lambda t: _masked(splits.mask_vectors(t.vectors, view="v1a").select("doc_id", "event_no", "embedding")))
_DRAWN = U.format("'42:' || v.view || ':' || doc_id || ':' || src || ':' || dst || ':' || rel")
query("augmented_views", f"SELECT v.view, doc_id, src, dst, rel FROM typed, (VALUES ('v1a', 0.2, 0.2), ('v1b', 0.2, 0.2), ('v2', 0.6, 0.1)) v(view, t, c) WHERE {_DRAWN} >= CASE WHEN rel <= 1 THEN v.t ELSE v.c END")(lambda t: splits.augmented_views(curation.typed_edges(t.causal, t.temporal), t.vectors)[0].select("view", "doc_id", "src", "dst", "rel"))
_ANY = U.format("'42:' || v.view || ':' || doc_id || ':' || event_no || ':' || k")
query("augmented_view_vectors", f"SELECT v.view, doc_id, event_no, {_GONE.format(_ANY, 'v.rate', _ANY, 'v.rate')} FROM vectors, (VALUES ('v1a', 0.15), ('v1b', 0.15), ('v2', 0.0)) v(view, rate)")(lambda t: _masked(splits.augmented_views(curation.typed_edges(t.causal, t.temporal), t.vectors)[1].select("view", "doc_id", "event_no", "embedding")))

# scores and ranks

query("competition_rank", "SELECT doc_id, event_id, rank() OVER (PARTITION BY doc_id ORDER BY score DESC)::BIGINT AS rank FROM tie")(lambda t: scoring.competition_rank(t.scores("tie")).select("doc_id", "event_id", "rank"))
query("unique_rank", "SELECT doc_id, event_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, event_id)::BIGINT AS rank FROM tie")(lambda t: scoring.unique_rank(t.scores("tie")).select("doc_id", "event_id", "rank"))
RICH = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"
query("richness", f"SELECT doc_id, event_no, round({RICH}, 6) AS rich FROM vectors")(lambda t: scoring.richness(t.vectors).select("doc_id", "event_no", r6("rich")))
RARE = "SELECT v.doc_id, v.event_no, coalesce(1 - (SELECT avg(p.sim) FROM (SELECT doc_id, i, j, sim FROM pair_sims UNION ALL SELECT doc_id, j, i, sim FROM pair_sims) p WHERE p.doc_id = v.doc_id AND p.i = v.event_no), 0) AS rare FROM vectors v"
query("rarity", f"SELECT doc_id, event_no, round(rare, 6) AS rare FROM ({RARE}) x")(lambda t: scoring.rarity(t.vectors).select("doc_id", "event_no", r6("rare")))


def _span(c: str) -> str:
    low, high = (f"{f}({c}) OVER (PARTITION BY doc_id)" for f in ("min", "max"))
    return f"round(CASE WHEN {high} - {low} < 1e-8 THEN 0 ELSE ({c} - {low}) / ({high} - {low}) END, 6) AS {c}"


query("semantic_scores", f"SELECT doc_id, event_no, score, rich, rare FROM (SELECT doc_id, event_no, {_span('score')}, {_span('rich')}, {_span('rare')} FROM (SELECT x.doc_id, x.event_no, {RICH} + 0.3 * x.rare AS score, {RICH} AS rich, x.rare FROM ({RARE}) x JOIN vectors USING (doc_id, event_no)) y) z")(
    lambda t: scoring.semantic_scores(scoring.richness(t.vectors), scoring.rarity(t.vectors))
)
query("semantic_ranking", "SELECT doc_id, event_no, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, event_no)::BIGINT AS rank FROM tie")(lambda t: scoring.semantic_ranking(t.scores("tie")).select("doc_id", "event_no", "rank"))
query("scale_scores", "SELECT doc_id, event_no, round((score - avg(score) OVER w) / (coalesce(stddev_samp(score) OVER w, 0) + 1e-6), 6) + 0.0::DOUBLE AS z, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-6), 6) AS m, round(1 / (1 + exp(-score)), 6) AS s FROM topo WINDOW w AS (PARTITION BY doc_id)")(
    lambda t: scoring.scale_scores(scoring.scale_scores(scoring.scale_scores(t.scores("topo"), "zscore").withColumnRenamed("scaled", "z"), "minmax").withColumnRenamed("scaled", "m"), "sigmoid").select("doc_id", "event_no", (F.round("z", 6) + 0.0).alias("z"), r6("m"), r6("scaled", "s"))
)
query("scale_in_sequence", "SELECT doc_id, event_no, round(1 / (1 + exp(-(score - avg(score) OVER w) / (coalesce(stddev_samp(score) OVER w, 0) + 1e-6))), 6) AS z, round(1 / (1 + exp(-(score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-6))), 6) AS m FROM topo WINDOW w AS (PARTITION BY doc_id)")(
    lambda t: scoring.scale_scores(scoring.scale_scores(t.scores("topo"), "sigmoid", "zscore").withColumnRenamed("scaled", "z"), "sigmoid", "minmax").select("doc_id", "event_no", r6("z"), r6("scaled", "m"))
)
query("short_label", "SELECT doc_id, event_no, event_id || ' ★' || printf('%.2f', score) AS label FROM topo")(lambda t: t.scores("topo").select("doc_id", "event_no", scoring.short_label(F.col("event_id"), F.col("score")).alias("label")))
query("degree_norm", "SELECT doc_id, event_no, round(d / (max(d) OVER w + 1e-6), 6) AS a, round(ln(1 + d) / (max(ln(1 + d)) OVER w + 1e-6), 6) AS b, round(sqrt(d) / (max(sqrt(d)) OVER w + 1e-6), 6) AS c FROM (SELECT doc_id, event_no, greatest(1, in_degree + out_degree)::DOUBLE AS d FROM degree) x WINDOW w AS (PARTITION BY doc_id)")(
    lambda t: scoring.degree_norm(scoring.degree_norm(scoring.degree_norm(graphs.degrees(t.nodes, t.edges), "max").withColumnRenamed("norm", "a"), "log").withColumnRenamed("norm", "b"), "sqrt").select("doc_id", "event_no", r6("a"), r6("b"), r6("norm", "c"))
)


def _combined(t: Tables) -> DataFrame:
    return scoring.combined_scores(scoring.unique_rank(t.scores("topo")), scoring.semantic_ranking(t.scores("sem")))


query("combined_scores", "SELECT doc_id, event_id, round(topo_score, 6) AS topo_score, round(sem_score, 6) AS sem_score, topo_rank, sem_rank, round(combined, 6) AS combined, row_number() OVER (PARTITION BY doc_id ORDER BY combined DESC, event_id)::BIGINT AS combined_rank, round(sem_score * 2, 6) AS rich, round(CASE WHEN sem_rank < 999 THEN 1 - sem_score ELSE 0 END, 6) AS rare, 1.0::DOUBLE AS w_rich, 0.3::DOUBLE AS w_rare FROM combined")(
    lambda t: scoring.combined_scores(scoring.unique_rank(t.scores("topo")), scoring.semantic_ranking(t.scores("sem")).withColumn("rich", F.col("score") * 2).withColumn("rare", 1 - F.col("score"))).select("doc_id", "event_id", r6("topo_score"), r6("sem_score"), "topo_rank", "sem_rank", r6("combined"), "combined_rank", r6("rich"), r6("rare"), "w_rich", "w_rare")
)
query("key_node_table", "SELECT c.doc_id, c.event_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.combined DESC, c.event_id)::BIGINT AS combined_rank, CASE WHEN length(n.text) > 16 THEN substr(n.text, 1, 16) || '…' ELSE n.text END AS shown, round(c.combined, 6) AS combined, round(c.topo_score, 6) AS topo_score, round(c.sem_score, 6) AS sem_score, c.topo_rank, c.sem_rank FROM combined c LEFT JOIN nodes n ON n.doc_id = c.doc_id AND n.event_id = c.event_id WHERE c.doc_id IN (SELECT doc_id FROM topo) AND c.doc_id IN (SELECT doc_id FROM sem)")(
    lambda t: scoring.key_node_table(t.nodes, scoring.unique_rank(t.scores("topo")), scoring.semantic_ranking(t.scores("sem")))[0].select("doc_id", "event_id", "combined_rank", "shown", r6("combined"), r6("topo_score"), r6("sem_score"), "topo_rank", "sem_rank")
)
query("key_node_table_missing", "SELECT * FROM (SELECT d.doc_id, array_to_string(list_filter([CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM sized) THEN 'graph' END, CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM topo) OR d.doc_id % 6 = 0 THEN 'topology' END, CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM sem) OR d.doc_id % 4 = 0 THEN 'semantic' END], lambda x: x IS NOT NULL), ',') AS missing FROM sized d) x WHERE missing <> ''")(
    lambda t: scoring.key_node_table(t.nodes, scoring.unique_rank(t.scores("topo").where("doc_id % 6 != 0")), scoring.semantic_ranking(t.scores("sem").where("doc_id % 4 != 0")))[1].select("doc_id", "missing")
)
query("reweight", "SELECT doc_id, event_id, w AS w_topo, round(w * topo_score + (1 - w) * sem_score, 6) AS combined, row_number() OVER (PARTITION BY doc_id, w ORDER BY w * topo_score + (1 - w) * sem_score DESC, event_id)::BIGINT AS rank FROM combined, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) v(w)")(lambda t: scoring.reweight(_combined(t), [0.25, 0.75]).select("doc_id", "event_id", "w_topo", r6("combined"), "rank"))
query("score_color", "SELECT doc_id, event_no, format('#{:02x}{:02x}{:02x}', trunc(219 - 5 * score)::INT, trunc(238 - 199 * score)::INT, trunc(255 - 215 * score)::INT) AS color FROM topo")(lambda t: t.scores("topo").select("doc_id", "event_no", scoring.score_color("score").alias("color")))
_BODY = "rtrim(regexp_replace(event_id || ': ' || text, '(.{14})', '\\1' || chr(10), 'g'), chr(10))"
query("node_label", f"SELECT doc_id, event_no, {_BODY} || chr(10) || '▲ ' || printf('%.2f', score) || ' (#' || rank || ')' AS label FROM nodes JOIN topo_ranked USING (doc_id, event_no, event_id)")(
    lambda t: t.nodes.join(scoring.unique_rank(t.scores("topo")), ["doc_id", "event_no", "event_id"]).select("doc_id", "event_no", scoring.node_label(F.col("event_id"), F.col("text"), F.col("score"), F.col("rank")).alias("label"))
)
#: The same without the last line, of events without a score as well.
query("node_label_whole", "SELECT doc_id, event_no, rtrim(regexp_replace(event_id || ': ' || text, '(.{14})', '\\1' || chr(10), 'g'), chr(10)) AS body FROM nodes")(
    lambda t: t.nodes.select("doc_id", "event_no", F.regexp_replace(scoring.node_label(F.col("event_id"), F.col("text"), F.lit(0.5), F.lit(1)), "\n▲ 0.50 \\(#1\\)$", "").alias("body"))
)
query("strip_doc_suffix", "SELECT doc_id, substr(doc_name, 1, length(doc_name) - 4) AS stem FROM docs")(lambda t: t.docs.select("doc_id", scoring.strip_doc_suffix(F.regexp_replace("doc_name", "txt$", "TxT")).alias("stem")))
query("score_profile", "SELECT doc_id, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(max(score) - min(score), 6) AS range, round(avg(CASE WHEN score = 0 THEN 1.0 ELSE 0 END), 6) AS share_zero, round(avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0 END), 6) AS share_small, round(avg(CASE WHEN score > 0.95 THEN 1.0 ELSE 0 END), 6) AS share_large FROM topo GROUP BY doc_id")(
    lambda t: scoring.score_profile(t.scores("topo")).select("doc_id", *[r6(c) for c in ("low", "high", "mean", "std", "range", "share_zero", "share_small", "share_large")])
)
_LAYERS = scoring.PARAMS["layers"]
_dot = lambda weights, bias, names: " + ".join(f"({w}::DOUBLE) * {n}" for w, n in zip(weights, names, strict=True)) + f" + ({bias}::DOUBLE)"
_HIDDEN = ", ".join(f"greatest(0, {_dot(w, b, graphs.FEATURES)}) AS h{k}" for k, (w, b) in enumerate(zip(*_LAYERS[0], strict=True)))
_SCALED = ", ".join(_scaled(c).replace("round(", "", 1).replace(", 6) AS", " AS") for c in graphs.FEATURES)
_MLP = f"SELECT doc_id, event_no, CASE WHEN y >= 0 THEN y ELSE 0.1 * y END AS y FROM (SELECT doc_id, event_no, {_dot(_LAYERS[1][0][0], _LAYERS[1][1][0], ['h0', 'h1'])} AS y FROM (SELECT doc_id, event_no, {_HIDDEN} FROM (SELECT doc_id, event_no, {_SCALED} FROM features) a) b) c"
query("mlp_scores", f"SELECT doc_id, event_no, round(y, 6) AS score FROM ({_MLP}) m")(lambda t: scoring.mlp_scores(graphs.node_features(t.nodes, t.edges), scoring.PARAMS["layers"]).select("doc_id", "event_no", r6("score")))


def _h(t: Tables) -> DataFrame:
    return t.scores("topo").select("doc_id", "event_no", F.array("score", F.lit(1) - F.col("score")).alias("x"))


def _sum(terms: list[tuple[float, str]]) -> str:
    return " + ".join(f"({w}::DOUBLE) * {c}" for w, c in terms)


def _attention_sql(h: str, layer: scoring.Layer) -> str:
    """One attention layer over the columns x0, x1, ... of `h`."""
    w, a = layer
    size = len(w[0])
    names = [(head, k, f"w{head}_{k}") for head in range(len(w)) for k in range(size)]
    projected = f"SELECT doc_id, event_no, {', '.join(_sum([(v, f'x{n}') for n, v in enumerate(w[head][k])]) + f' AS {c}' for head, k, c in names)} FROM {h}"
    logits = ", ".join(_sum([(a[head][k], f"s.w{head}_{k}") for k in range(size)] + [(a[head][size + k], f"d.w{head}_{k}") for k in range(size)]) + f" AS l{head}" for head in range(len(w)))
    weights = ", ".join(f"exp(CASE WHEN l{head} >= 0 THEN l{head} ELSE 0.2 * l{head} END) AS p{head}" for head in range(len(w)))
    means = ", ".join(f"sum(p{head} * {c}) / sum(p{head}) AS {c}" for head, _, c in names)
    last = ", ".join(f"CASE WHEN coalesce(z.{c}, 0) >= 0 THEN coalesce(z.{c}, 0) ELSE 0.01 * z.{c} END AS x{n}" for n, (_, _, c) in enumerate(names))
    own = ", ".join(f"s.{c}" for _, _, c in names)
    return f"SELECT h.doc_id, h.event_no, {last} FROM {h} h LEFT JOIN (WITH p AS MATERIALIZED ({projected}) SELECT doc_id, j, {means} FROM (SELECT *, {weights} FROM (SELECT e.doc_id, e.j, {own}, {logits} FROM edges e JOIN p s ON s.doc_id = e.doc_id AND s.event_no = e.i JOIN p d ON d.doc_id = e.doc_id AND d.event_no = e.j) q) r GROUP BY doc_id, j) z ON z.doc_id = h.doc_id AND z.j = h.event_no"


def _influence_sql(h: str, p: list[float], b: float) -> str:
    n = range(len(p))
    near = ", ".join(f"sum(a.x{k}) AS s{k}" for k in n)
    local = " + ".join(f"h.x{k} * (coalesce(q.s{k}, 0) + h.x{k})" for k in n)
    wide = " + ".join(f"({v}::DOUBLE) * (h.x{k} + coalesce(q.s{k}, 0))" for k, v in enumerate(p))
    return f"SELECT h.doc_id, h.event_no, round(({local}) / (coalesce(q.n, 0) + 1) + g.dd / (g.md + 1e-6) + ({wide}) / (g.dd + 1) + ({b}), 9) AS score FROM {h} h JOIN (SELECT *, max(dd) OVER (PARTITION BY doc_id) AS md FROM (SELECT h.doc_id, h.event_no, greatest(1, (SELECT count(*) FROM edges e JOIN {h} o ON o.doc_id = e.doc_id AND o.event_no = e.i WHERE e.doc_id = h.doc_id AND e.j = h.event_no) + (SELECT count(*) FROM edges e JOIN {h} o ON o.doc_id = e.doc_id AND o.event_no = e.j WHERE e.doc_id = h.doc_id AND e.i = h.event_no))::DOUBLE AS dd FROM {h} h) m) g ON g.doc_id = h.doc_id AND g.event_no = h.event_no LEFT JOIN (SELECT e.doc_id, e.j, count(*) AS n, {near} FROM edges e JOIN {h} a ON a.doc_id = e.doc_id AND a.event_no = e.i GROUP BY e.doc_id, e.j) q ON q.doc_id = h.doc_id AND q.j = h.event_no"


_ONE = scoring.PARAMS["attention"]
_TOPO = "h0 AS MATERIALIZED (SELECT doc_id, event_no, score AS x0, 1 - score AS x1 FROM topo)"
_TWO_WIDE = [([[[0.8, -0.4], [0.3, 0.6]], [[-0.2, 0.7], [0.5, 0.1]]], [[0.5, -0.3, 0.2, 0.4], [0.1, 0.6, -0.5, 0.3]])]
query("attention_aggregate", f"WITH {_TOPO} SELECT doc_id, event_no, {', '.join(f'round(x{k}, 6) AS x{k}' for k in range(4))} FROM ({_attention_sql('h0', _TWO_WIDE[0])}) y".replace("WITH", "SELECT * FROM (WITH", 1) + ") z")(
    lambda t: scoring.attention_aggregate(_h(t), t.edges, _TWO_WIDE).select("doc_id", "event_no", *[F.round(F.col("x")[k], 6).alias(f"x{k}") for k in range(4)])
)
query("influence_score", f"SELECT doc_id, event_no, round(score, 6) AS score FROM (WITH {_TOPO} {_influence_sql('h0', [0.6, -0.2], 0.1)}) y")(lambda t: scoring.influence_score(_h(t), t.edges, [0.6, -0.2], 0.1).select("doc_id", "event_no", r6(F.round("score", 9), "score")))


def _related(t: Tables) -> DataFrame:
    """Two heads of two outputs, then one of two, with fixed parameters for any width of the embeddings."""
    first = t.read("embeddings").select("embedding").first()
    wave = lambda *shape: (np.cos(np.arange(int(np.prod(shape))) * 1.7) * 0.4).reshape(shape).tolist()
    layers = [{"w": wave(4, len(first[0]) if first else 0, 4), "a": wave(4, 4), "proj": wave(3, 4), "bias": wave(3), "q": wave(3), "heads": 2}, {"w": wave(4, 4, 4), "a": wave(4, 4), "proj": wave(3, 4), "bias": wave(3), "q": wave(3), "heads": 2}]
    return scoring.relation_attention(t.vectors, curation.typed_edges(t.causal, t.temporal), layers)


def _relation_layer(name: str, own: str, last: bool) -> str:
    """SQL of a layer over `own`, each event's four outputs by relation: each event's share of the relation (`w`) and mixed outputs, as `name`."""
    wave = lambda k: f"0.4 * cos(1.7 * ({k}))"
    logit = lambda h: " + ".join(f"{side}.o{2 * h + f} * {wave(f'e.rel * 4 + {2 * n + f}')}" for n, side in enumerate(("s", "d")) for f in range(2))
    p = lambda h: f"exp(least(10, CASE WHEN {logit(h)} >= 0 THEN {logit(h)} ELSE 0.2 * ({logit(h)}) END)) AS p{h}"
    elu = lambda x: f"CASE WHEN {x} > 0 THEN {x} ELSE exp(least({x}, 0)) - 1 END"
    part = lambda k: " + ".join(f"o{o} * {wave(4 * k + o)}" for o in range(4)) + f" + {wave(k)}"
    mixed = [f"sum(w * o{o})" for o in range(4)]
    out = f"({mixed[0]} + {mixed[2]}) / 2 AS y0, ({mixed[1]} + {mixed[3]}) / 2 AS y1, " + ", ".join(f"sum(w) FILTER (WHERE rel = {r}) AS w{r}" for r in range(4)) if last else ", ".join(f"{elu(m)} AS x{o}" for o, m in enumerate(mixed))
    return f"""{name}_own AS MATERIALIZED ({own}),
{name}_into AS (SELECT doc_id, dst, rel, {", ".join(f"sum(p{o // 2} * o{o}) / (sum(p{o // 2}) + 1e-12) AS m{o}" for o in range(4))} FROM (SELECT e.doc_id, e.dst, e.rel, s.o0, s.o1, s.o2, s.o3, {p(0)}, {p(1)} FROM typed e JOIN {name}_own s ON s.doc_id = e.doc_id AND s.event_no = e.src AND s.rel = e.rel JOIN {name}_own d ON d.doc_id = e.doc_id AND d.event_no = e.dst AND d.rel = e.rel) x GROUP BY doc_id, dst, rel),
{name}_channel AS (SELECT n.doc_id, n.event_no, n.rel, {", ".join(f"n.o{o} + coalesce(m.m{o}, 0) AS o{o}" for o in range(4))} FROM {name}_own n LEFT JOIN {name}_into m ON m.doc_id = n.doc_id AND m.dst = n.event_no AND m.rel = n.rel),
{name}_share AS (SELECT *, {" + ".join(f"({elu(f'({part(k)})')}) * {wave(k)}" for k in range(3))} AS logit FROM {name}_channel),
{name} AS MATERIALIZED (SELECT doc_id, event_no, {out} FROM (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY doc_id, event_no) AS w FROM {name}_share) x GROUP BY doc_id, event_no)"""


_FOUR = "(VALUES (0), (1), (2), (3)) r(rel)"
_FIRST_OWN = "SELECT n.doc_id, n.event_no, r.rel, " + ", ".join(f"list_dot_product(n.embedding::DOUBLE[], r.v{o}) AS o{o}" for o in range(4)) + " FROM vectors n, (SELECT rel, " + ", ".join(f"list_transform(range(d), lambda i: 0.4 * cos(1.7 * (rel * d * 4 + i * 4 + {o}))) AS v{o}" for o in range(4)) + f" FROM {_FOUR}, (SELECT len(embedding) AS d FROM embeddings LIMIT 1) x) r"
_NEXT_OWN = "SELECT n.doc_id, n.event_no, r.rel, " + ", ".join(" + ".join(f"n.x{i} * 0.4 * cos(1.7 * (r.rel * 16 + {4 * i + o}))" for i in range(4)) + f" AS o{o}" for o in range(4)) + f" FROM layer1 n, {_FOUR}"
_RELATED = f"WITH {_relation_layer('layer1', _FIRST_OWN, False)},\n{_relation_layer('layer2', _NEXT_OWN, True)}"
query("relation_attention", f"SELECT * FROM ({_RELATED} SELECT doc_id, event_no, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in ('y0', 'y1', 'w0', 'w1', 'w2', 'w3'))} FROM layer2) z")(lambda t: _related(t).select("doc_id", "event_no", *[(F.round(F.col("y")[i], 6) + 0.0).alias(f"y{i}") for i in range(2)], *[F.round(F.col("weights")[i], 6).alias(f"w{i}") for i in range(4)]))
query("relation_weights", f"SELECT * FROM ({_RELATED} SELECT doc_id, rel::INT AS rel, round(avg(CASE rel WHEN 0 THEN w0 WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END), 6) AS weight FROM layer2, {_FOUR} GROUP BY doc_id, rel) z")(lambda t: scoring.relation_weights(_related(t)))
_STEPS = ", ".join([f"step0 AS MATERIALIZED (SELECT doc_id, event_no, y AS x0 FROM ({_MLP}) m)", *(f"step{k + 1} AS MATERIALIZED ({_attention_sql(f'step{k}', layer)})" for k, layer in enumerate(_ONE))])
query("score_graphs", f"SELECT doc_id, event_no, round(score, 6) AS score, rank() OVER (PARTITION BY doc_id ORDER BY score DESC)::BIGINT AS rank FROM (WITH {_STEPS} {_influence_sql('step3', *scoring.PARAMS['influence'])}) x")(lambda t: scoring.score_graphs(t.nodes, t.edges).where("error IS NULL").select("doc_id", "event_no", r6("score"), "rank"))

# evaluation


def _judged(t: Tables) -> DataFrame:
    return t.scores("topo").join(t.scores("sem").select("doc_id", "event_no", F.col("score").alias("label")), ["doc_id", "event_no"])


JUDGED = "(SELECT t.doc_id, t.event_no, t.event_id, t.score, s.score AS label FROM topo t JOIN sem s USING (doc_id, event_no))"
query("kendall_tau", f"SELECT d.doc_id, round(coalesce(p.tau, 0), 6) AS tau FROM (SELECT DISTINCT doc_id FROM {JUDGED} q) d LEFT JOIN (SELECT a.doc_id, avg(sign(a.score - b.score) * sign(a.label - b.label)) AS tau FROM {JUDGED} a JOIN {JUDGED} b ON a.doc_id = b.doc_id AND a.event_no < b.event_no GROUP BY a.doc_id) p ON p.doc_id = d.doc_id")(lambda t: evaluate.kendall_tau(_judged(t)).select("doc_id", r6("tau")))
query("mse_by_doc", f"SELECT doc_id, round(avg((score - label) * (score - label)), 6) AS mse FROM {JUDGED} q GROUP BY doc_id")(lambda t: evaluate.mse_by_doc(_judged(t)).select("doc_id", r6("mse")))
query("confusion", f"SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM (SELECT count(*) FILTER (WHERE score > 0.7 AND label > 0.5) AS tp, count(*) FILTER (WHERE score > 0.7 AND label <= 0.5) AS fp, count(*) FILTER (WHERE score <= 0.7 AND label > 0.5) AS fn, count(*) FILTER (WHERE score <= 0.7 AND label <= 0.5) AS tn FROM {JUDGED} q) x")(
    lambda t: evaluate.confusion(_judged(t).withColumnRenamed("label", "member")).select("tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))
)
HITS = "(SELECT doc_id, max(hit) AS hit, CASE WHEN max(hit) > 0 THEN min(set_no) FILTER (WHERE hit = best) END AS set_no FROM (SELECT *, max(hit) OVER (PARTITION BY doc_id) AS best FROM (SELECT m.doc_id, m.set_no, count(*) FILTER (WHERE r.rank <= m.size) / max(m.size)::DOUBLE AS hit FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, set_no) AS size FROM set_members) m LEFT JOIN topo_ranked r ON r.doc_id = m.doc_id AND r.event_no = m.event_no GROUP BY m.doc_id, m.set_no) a) b GROUP BY doc_id)"
query("best_set_hit", f"SELECT doc_id, round(hit, 6) AS hit, set_no FROM {HITS} h")(lambda t: evaluate.best_set_hit(t.scores("topo"), t.removal_sets).select("doc_id", r6("hit"), "set_no"))
query("hit_summary", f"SELECT split, count(*) AS n, count(*) FILTER (WHERE hit = 1) AS n_full, count(*) FILTER (WHERE hit > 0 AND hit < 1) AS n_partial, count(*) FILTER (WHERE hit = 0) AS n_miss, round(100.0::DOUBLE * count(*) FILTER (WHERE hit = 1) / count(*), 6) AS pct_full, round(100.0::DOUBLE * count(*) FILTER (WHERE hit > 0 AND hit < 1) / count(*), 6) AS pct_partial, round(100.0::DOUBLE * count(*) FILTER (WHERE hit = 0) / count(*), 6) AS pct_miss FROM (SELECT h.hit, v.split FROM {HITS} h JOIN split s USING (doc_id), (VALUES ('test'), ('train'), ('all')) v(split) WHERE v.split = s.split OR v.split = 'all') x GROUP BY split")(
    lambda t: evaluate.hit_summary(evaluate.best_set_hit(t.scores("topo"), t.removal_sets), splits.train_test_split(_sizes(t))).select("split", "n", "n_full", "n_partial", "n_miss", r6("pct_full"), r6("pct_partial"), r6("pct_miss"))
)
query("missed_documents", f"SELECT h.doc_id, s.split FROM {HITS} h JOIN split s USING (doc_id) WHERE h.hit = 0")(lambda t: evaluate.missed_documents(evaluate.best_set_hit(t.scores("topo"), t.removal_sets), splits.train_test_split(_sizes(t))))
query("rank_comparison", "SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.event_id)::BIGINT AS true_rank, s.event_id, t.rank AS model_rank, round(coalesce(t.score, 0), 6) AS score, round(s.score, 6) AS label FROM sem s JOIN split p ON p.doc_id = s.doc_id AND p.split = 'test' LEFT JOIN topo_ranked t ON t.doc_id = s.doc_id AND t.event_no = s.event_no")(
    lambda t: evaluate.rank_comparison(t.scores("sem").select("doc_id", "event_id", F.col("score").alias("label")), t.scores("topo"), splits.train_test_split(_sizes(t)).where("split = 'test'")).select("doc_id", "true_rank", "event_id", "model_rank", r6("score"), r6("label"))
)
query("inference_ranking", "SELECT t.doc_id, t.event_id, round(t.score, 6) AS score, t.rank FROM topo_ranked t JOIN sized s ON s.doc_id = t.doc_id WHERE s.n > 30")(lambda t: evaluate.inference_ranking(t.scores("topo"), _sizes(t)).select("doc_id", "event_id", r6("score"), "rank"))


def _folds(t: Tables) -> DataFrame:
    """Evaluation of each fold and of two seeds' folds: loss, F1, tau, hits and counts of pairs of scores and labels."""
    rows = _judged(t).withColumnRenamed("label", "member").withColumn("label", F.col("member"))
    fold = splits.kfold(_sizes(t), 2)
    out = None
    for seed, kind in ((1, "topo"), (2, "tie")):
        own = rows if kind == "topo" else t.scores("tie").join(t.scores("sem").select("doc_id", "event_no", F.col("score").alias("label")), ["doc_id", "event_no"]).withColumn("member", F.col("label"))
        own = own.join(fold, "doc_id")
        loss = own.groupBy("fold", "doc_id").agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("mse")).groupBy("fold").agg(F.avg("mse").alias("loss"))
        tau = evaluate.kendall_tau(own).join(fold, "doc_id").groupBy("fold").agg(F.avg("tau").alias("tau"))
        hits = evaluate.best_set_hit(own, t.removal_sets).join(fold, "doc_id").groupBy("fold").agg(F.count_if(F.col("hit") > 0).alias("hits"), F.count("*").alias("docs"))
        one = evaluate.confusion(own, ["fold"]).join(loss, "fold").join(tau, "fold").join(hits, "fold").withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("tp", "fp", "fn", "tn"))
query("fold_summary", f"SELECT round(avg(loss), 6) AS loss_mean, round(stddev_pop(loss), 6) AS loss_std, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg(tau), 6) AS tau_mean, round(sum(hits)::DOUBLE / sum(docs), 6) AS hit_rate, {_SUMS} FROM fold_rows WHERE seed = 1")(lambda t: _rounded(evaluate.fold_summary(_folds(t).where("seed = 1"))))
query("seed_summary", f"SELECT count(*)::BIGINT AS n_seeds, {', '.join(f'round(avg({c}), 6) AS {n}_mean, round(stddev_pop({c}), 6) AS {n}_std' for c, n in (('hit', 'hit_rate'), ('tau', 'tau'), ('f1', 'f1')))}, {_SUMS} FROM (SELECT seed, sum(hits)::DOUBLE / sum(docs) AS hit, avg(tau) AS tau, avg(f1) AS f1, {_SUMS} FROM fold_rows GROUP BY seed) x")(lambda t: _rounded(evaluate.seed_summary(_folds(t))))
def _view_sql(view: str | None) -> str:
    """Components of the vectors of a view, one a row: `p` is the vector, `k` the component."""
    drawn = U.format(f"'42:{view}:' || doc_id || ':' || event_no || ':' || k")
    x = f"CASE WHEN {drawn} < 0.15 THEN 0 ELSE x END" if view else "x"
    return f"(SELECT p, k, {x} AS x FROM (SELECT doc_id, event_no, (doc_id, event_no) AS p, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS k FROM vectors) e)"


def _agreement_sql(a: str | None, b: str | None) -> str:
    """SQL of the parts of the agreement of two views, from sums over vectors, of products of components too."""
    parts = []
    for n, view in enumerate((a, b)):
        v = f"v{n} AS MATERIALIZED {_view_sql(view)}"
        cov = f"cov{n} AS MATERIALIZED (SELECT x.k, y.k AS other, covar_samp(x.x, y.x) AS c FROM v{n} x JOIN v{n} y ON x.p = y.p GROUP BY x.k, y.k)"
        parts += [v, cov]
    size = "(SELECT max(k) + 1 FROM v0)"
    variance = " + ".join(f"(SELECT avg(greatest(0, 1 - sqrt(c + 1e-4))) FROM cov{n} WHERE k = other)" for n in range(2))
    covariance = " + ".join(f"(SELECT sum(c * c) FROM cov{n} WHERE k <> other) / {size}" for n in range(2))
    return f"WITH {', '.join(parts)} SELECT *, 25 * invariance + 25 * variance + covariance AS loss FROM (SELECT (SELECT avg((x.x - y.x) * (x.x - y.x)) FROM v0 x JOIN v1 y ON x.p = y.p AND x.k = y.k) AS invariance, ({variance}) / 2 AS variance, ({covariance}) / 2 AS covariance) r"


_R6 = "round(invariance, 6) AS {0}invariance, round(variance, 6) AS {0}variance, round(covariance, 6) AS {0}covariance, round(loss, 6) AS {0}loss"
query("view_agreement", f"SELECT {_R6.format('')} FROM ({_agreement_sql('v1a', 'v1b')}) z")(lambda t: evaluate.view_agreement(splits.mask_vectors(t.vectors, view="v1a"), splits.mask_vectors(t.vectors, view="v1b")).select(r6("invariance"), r6("variance"), r6("covariance"), r6("loss")))
query("three_view_loss", f"SELECT r.* EXCLUDE (whole), c.* EXCLUDE (whole), round(r.whole + 0.5 * c.whole, 6) AS total FROM (SELECT {_R6.format('robust_')}, loss AS whole FROM ({_agreement_sql('v1a', 'v1b')}) z) r, (SELECT {_R6.format('causal_')}, loss AS whole FROM ({_agreement_sql('v1b', None)}) z) c")(lambda t: _rounded(evaluate.three_view_loss(splits.mask_vectors(t.vectors, view="v1a"), splits.mask_vectors(t.vectors, view="v1b"), t.vectors)))

# incremental work and review


def _sources(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("source_hash"))


def _checkpoints(t: Tables) -> DataFrame:
    return _sources(t).where("doc_id % 13 != 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("source_hash")).alias("source_hash"), (F.col("doc_id") % 5 != 0).alias("judge_done"))


query("plan_resume", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN 'restart' WHEN doc_id % 5 <> 0 AND doc_id % 11 <> 0 THEN 'skip' ELSE 'continue' END AS action FROM documents")(lambda t: incremental.plan_resume(_sources(t), _checkpoints(t), t.documents.where("doc_id % 11 != 0")))
query("pending_experts", "SELECT d.doc_id, e.round, e.expert FROM documents d, (VALUES (0, 'temporal'), (0, 'precondition'), (1, 'discourse'), (1, 'commonsense')) e(round, expert) WHERE NOT (d.doc_id % 3 = 0 AND e.round = 0) AND NOT (d.doc_id % 4 = 0 AND e.expert = 'discourse')")(
    lambda t: incremental.pending_experts(
        t.documents.select("doc_id", F.inline(F.array(*[F.struct(F.lit(r).alias("round"), F.lit(e).alias("expert")) for r, _, e, _ in prep.EXPERTS]))),
        t.documents.select("doc_id", F.inline(F.array(*[F.struct(F.lit(r).alias("round"), F.lit(e).alias("expert")) for r, _, e, _ in prep.EXPERTS]))).where("(doc_id % 3 = 0 AND round = 0) OR (doc_id % 4 = 0 AND expert = 'discourse')"),
    )
)
query("pending_outputs", "SELECT doc_id, CASE WHEN n < 3 THEN 'too_small' WHEN n > 30 THEN 'too_big' WHEN doc_id % 11 <> 0 THEN 'stored' ELSE 'pending' END AS state FROM sized")(lambda t: incremental.pending_outputs(_sizes(t), t.documents.where("doc_id % 11 != 0")))


@query("embedding_cache_split", "SELECT doc_id, doc_id % 10 <> 0 AND doc_id % 6 <> 0 AND doc_id % 9 <> 0 AS hit FROM sized")
def embedding_cache_split(t: Tables) -> DataFrame:
    hashes = prep.text_list_hash(t.nodes)
    meta = hashes.where("doc_id % 10 != 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "changed").otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 9 == 0, "other").otherwise("model-a").alias("model_name"))
    return incremental.embedding_cache_split(hashes, meta, "model-a")


query("merge_vectors", "SELECT doc_id, event_no, doc_id % 3 = 0 AS is_fresh, array_to_string(list_transform(embedding, lambda x: round((CASE WHEN doc_id % 3 = 0 THEN 1 - x::DOUBLE ELSE x::DOUBLE END) * 1e6)::BIGINT), ',') AS vector FROM vectors")(
    lambda t: incremental.merge_vectors(t.vectors.where("doc_id % 3 != 0 OR doc_id % 2 = 0"), t.vectors.where("doc_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: 1 - x.cast("double")))).select("doc_id", "event_no", "is_fresh", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long")), ",").alias("vector"))
)
query("review_diff", "SELECT doc_id, i, j, action, ot AS old_type, nt AS new_type, coalesce(CASE WHEN action = 'deleted' THEN o_reason ELSE n_reason END, '') AS reason, '2024-01-01 00:00:00' AS ts, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN action = 'added' THEN 1 ELSE 0 END, i, j)::BIGINT AS record_no, CASE WHEN action = 'modified' THEN 'modified E' || i || ' -> E' || j || ': ' || ot || ' to ' || nt ELSE action || ' E' || i || ' -> E' || j || ' (' || coalesce(ot, nt) || ')' END || ' [2024-01-01 00:00:00]' AS summary FROM (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.i, n.i) AS i, coalesce(o.j, n.j) AS j, o.edge_type AS ot, n.edge_type AS nt, o.reason AS o_reason, n.reason AS n_reason, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.doc_id IS NULL THEN 'added' WHEN o.edge_type <> n.edge_type THEN 'modified' END AS action FROM review_old o FULL JOIN review_new n ON o.doc_id = n.doc_id AND o.i = n.i AND o.j = n.j) x WHERE action IS NOT NULL")(
    lambda t: incremental.review_diff(t.review_old, t.review_new, "2024-01-01 00:00:00")
)


@query("preserve_metadata", "SELECT n.doc_id, n.i, n.j, n.edge_type, coalesce(n.reason, o.reason) AS reason, o.i * 10 AS score, 'note=new ' || n.j || CASE WHEN o.i IS NOT NULL THEN ';seen=old ' || n.i ELSE '' END AS attributes FROM review_new n LEFT JOIN review_old o ON o.doc_id = n.doc_id AND o.i = n.i AND o.j = n.j AND o.edge_type = n.edge_type")
def preserve_metadata(t: Tables) -> DataFrame:
    """Old edges have a score, a note and a second attribute; new ones a note of their own."""
    said = lambda c, side: F.concat(F.lit(f"{side} "), F.col(c).cast("string"))
    old = t.review_old.withColumn("score", F.col("i") * 10).withColumn("attributes", F.create_map(F.lit("note"), said("j", "old"), F.lit("seen"), said("i", "old")))
    new = t.review_new.withColumn("attributes", F.create_map(F.lit("note"), said("j", "new")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return incremental.preserve_metadata(old, new).withColumn("attributes", listed)


@query("merge_review_history", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, record_no)::BIGINT AS place, record FROM (SELECT doc_id, 0 AS part, min(i * 100000 + j) AS record_no, 'rec ' || i AS record FROM causal GROUP BY doc_id, i UNION ALL SELECT doc_id, 1, min(i * 100000 + j), 'rec ' || i FROM temporal t WHERE NOT EXISTS (SELECT 1 FROM causal c WHERE c.doc_id = t.doc_id AND c.i = t.i) GROUP BY doc_id, i UNION ALL SELECT doc_id, 2, i * 100000 + j, 'rec ' || i FROM added) x")
def merge_review_history(t: Tables) -> DataFrame:
    record = lambda df: df.select("doc_id", (F.col("i") * 100000 + F.col("j")).alias("record_no"), F.concat(F.lit("rec "), F.col("i").cast("string")).alias("record"))
    return incremental.merge_review_history(record(t.causal), record(t.temporal), record(t.added))


#: Every event is an anchor.
query("edge_addition_candidates", "SELECT a.doc_id, a.event_no AS anchor, r.role, b.event_no FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.event_no <> b.event_no, (VALUES ('source'), ('target')) r(role) EXCEPT (SELECT doc_id, j, 'source', i FROM closure UNION ALL SELECT doc_id, i, 'target', j FROM closure UNION ALL SELECT doc_id, i, 'source', j FROM edges UNION ALL SELECT doc_id, j, 'target', i FROM edges)")(
    lambda t: incremental.edge_addition_candidates(t.nodes, t.edges, graphs.reachable_pairs(t.edges), t.nodes.select("doc_id", F.col("event_no").alias("anchor"))).select("doc_id", "anchor", "role", "event_no")
)
query("reversible_edges", "SELECT t.doc_id, t.i, t.j FROM edges t WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN closure c ON c.doc_id = e.doc_id AND c.i = e.j WHERE e.doc_id = t.doc_id AND e.i = t.i AND c.j = t.j)")(lambda t: incremental.reversible_edges(t.edges, graphs.reachable_pairs(t.edges)))
query("apply_review_edits", "SELECT doc_id, CASE WHEN m = 3 AND free THEN j ELSE i END AS i, CASE WHEN m = 3 AND free THEN i ELSE j END AS j, CASE WHEN m = 1 THEN CASE WHEN edge_type = 'causal' THEN 'temporal' ELSE 'causal' END ELSE edge_type END AS edge_type, CASE WHEN m = 1 THEN 'edit ' || j ELSE reason END AS reason, m = 1 OR (m = 3 AND free) AS manual_review FROM (SELECT *, (doc_id + i + j) % 9 AS m, NOT EXISTS (SELECT 1 FROM edges e JOIN closure c ON c.doc_id = e.doc_id AND c.i = e.j WHERE e.doc_id = o.doc_id AND e.i = o.i AND c.j = o.j) AS free FROM review_old o) x WHERE m <> 0 UNION ALL SELECT doc_id, i, j, edge_type, reason, true FROM added")(
    lambda t: incremental.apply_review_edits(t.review_old, t.edits)
)
DAY = 86_400_000_000
#: Limits of requests and tokens in a day that some calls reach.
RPM, TPM = 2, 150
query("trailing_usage", f"SELECT client, call_id, tokens, n_requests, n_tokens, n_requests - 1 >= {RPM} AS over_rpm, n_tokens - tokens + greatest(1, least(tokens, {TPM})) > {TPM} AS over_tpm FROM (SELECT a.user_id AS client, a.event_id AS call_id, floor(a.value)::BIGINT AS tokens, count(*)::BIGINT AS n_requests, sum(floor(b.value))::BIGINT AS n_tokens FROM (SELECT *, epoch_us(ts) AS us FROM events) a JOIN (SELECT *, epoch_us(ts) AS us FROM events) b ON a.user_id = b.user_id AND b.us > a.us - {DAY} AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id)) GROUP BY a.user_id, a.event_id, a.value) x")(
    lambda t: incremental.trailing_usage(t.read("events").select(F.col("user_id").alias("client"), F.col("event_id").alias("call_id"), "ts", F.floor("value").cast("long").alias("tokens")), DAY, RPM, TPM).select("client", "call_id", "tokens", "n_requests", "n_tokens", "over_rpm", "over_tpm")
)
