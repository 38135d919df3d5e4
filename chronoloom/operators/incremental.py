"""Incremental work and the review log: what to redo, cached vectors, differences of reviewed graphs, edits, usage windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import reachable_pairs

KEY = ["doc_id", "i", "j"]


def plan_resume(sources: DataFrame, checkpoints: DataFrame, outputs: DataFrame) -> DataFrame:
    """`doc_id`, `action`: skip (same source, judged, output there), continue (same source), else restart."""
    rows = sources.select("doc_id", "source_hash").join(checkpoints.select("doc_id", F.col("source_hash").alias("was"), "judge_done"), "doc_id", "left")
    rows = rows.join(outputs.select("doc_id").distinct().withColumn("there", F.lit(True)), "doc_id", "left")
    same = F.coalesce(F.col("was") == F.col("source_hash"), F.lit(False))
    action = F.when(same & F.coalesce("judge_done", F.lit(False)) & F.col("there").isNotNull(), "skip").when(same, "continue").otherwise("restart")
    return rows.select("doc_id", action.alias("action"))


def pending_experts(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of `wanted` (doc_id, round, expert) that no stored record completes."""
    return wanted.join(done, ["doc_id", "round", "expert"], "left_anti")


def pending_outputs(sizes: DataFrame, outputs: DataFrame, low: int = 3, high: int = 30) -> DataFrame:
    """`doc_id`, `state`: too_small, too_big, stored, or pending."""
    there = outputs.select("doc_id").distinct().withColumn("there", F.lit(True))
    n = F.col("n_nodes")
    state = F.when(n < low, "too_small").when(n > high, "too_big").when(F.col("there"), "stored").otherwise("pending")
    return sizes.join(there, "doc_id", "left").select("doc_id", state.alias("state"))


def embedding_cache_split(hashes: DataFrame, meta: DataFrame, model: str) -> DataFrame:
    """`doc_id`, `hit`: whether the stored model name and text hash are both equal."""
    rows = hashes.select("doc_id", "hash").join(meta.select("doc_id", F.col("hash").alias("was"), "model_name"), "doc_id", "left")
    return rows.select("doc_id", (F.col("was").eqNullSafe(F.col("hash")) & F.col("model_name").eqNullSafe(F.lit(model))).alias("hit"))


def merge_vectors(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors of both tables, the fresh one where both have one; `is_fresh` tells which."""
    key = ["doc_id", "event_no"]
    rows = cached.select(*key, F.col("embedding").alias("old")).join(fresh.select(*key, F.col("embedding").alias("new")), key, "full_outer")
    return rows.select(*key, F.coalesce("new", "old").alias("embedding"), F.col("new").isNotNull().alias("is_fresh"))


def _by_key(edges: DataFrame) -> DataFrame:
    """One row for each edge: temporal overrides causal."""
    first = F.max_by(F.struct("edge_type", "reason"), F.when(F.col("edge_type") == "temporal", 1).otherwise(0))
    return edges.groupBy(*KEY).agg(first.alias("e")).select(*KEY, "e.*")


def review_diff(old: DataFrame, new: DataFrame, ts: str) -> DataFrame:
    """`doc_id`, `i`, `j`, `action` (deleted, modified, added), types, `reason` (of a deleted edge the old one), `ts`, `summary`, and
    `record_no`: the changes of each document, deleted and modified ones by old order, then added ones."""
    a = _by_key(old).select(*KEY, F.col("edge_type").alias("old_type"), F.col("reason").alias("old_reason"))
    b = _by_key(new).select(*KEY, F.col("edge_type").alias("new_type"), F.col("reason").alias("new_reason"))
    rows = a.join(b, KEY, "full_outer")
    action = F.when(F.col("new_type").isNull(), "deleted").when(F.col("old_type").isNull(), "added").when(F.col("old_type") != F.col("new_type"), "modified")
    rows = rows.withColumn("action", action).where("action IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("action") == "added", 1).otherwise(0), "i", "j")
    when = F.lit(f" [{ts}]")
    summary = F.when(F.col("action") == "modified", F.format_string("modified E%d -> E%d: %s to %s", "i", "j", "old_type", "new_type")).otherwise(F.format_string("%s E%d -> E%d (%s)", "action", "i", "j", F.coalesce("old_type", "new_type")))
    reason = F.coalesce(F.when(F.col("action") == "deleted", F.col("old_reason")).otherwise(F.col("new_reason")), F.lit(""))
    return rows.select(*KEY, "action", "old_type", "new_type", reason.alias("reason"), F.lit(ts).alias("ts"), F.concat(summary, when).alias("summary"), F.row_number().over(order).cast("long").alias("record_no"))


def preserve_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """New edges with what they lack of the old edge of the same key and type: each column that is null or missing, and in columns of
    maps each missing entry."""
    key = [*KEY, "edge_type"]
    rest = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c not in key]
    rows = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in rest if c in new.columns])
    rows = rows.join(old.select(*key, *[F.col(c).alias(f"old_{c}") for c in rest if c in old.columns]), key, "left")

    def kept(c: str) -> Column:
        if c not in old.columns or c not in new.columns:
            return F.col(f"new_{c}" if c in new.columns else f"old_{c}")
        own, was = F.col(f"new_{c}"), F.col(f"old_{c}")
        if isinstance(new.schema[c].dataType, T.MapType):
            more = F.map_filter(was, lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
            return F.when(own.isNull(), was).when(was.isNull(), own).otherwise(F.map_concat(own, more))
        return F.coalesce(own, was)

    return rows.select(*key, *[kept(c).alias(c) for c in rest])


def merge_review_history(old: DataFrame, new: DataFrame, records: DataFrame) -> DataFrame:
    """`doc_id`, `place`, `record`: the old then the new history without repeats, then all of this session's records."""
    rows = old.select("doc_id", F.lit(0).alias("part"), "record_no", "record").union(new.select("doc_id", F.lit(1).alias("part"), "record_no", "record"))
    first = F.row_number().over(Window.partitionBy("doc_id", "record").orderBy("part", "record_no"))
    rows = rows.withColumn("n", first).where("n = 1").drop("n").union(records.select("doc_id", F.lit(2).alias("part"), "record_no", "record"))
    order = Window.partitionBy("doc_id").orderBy("part", "record_no", "record")
    return rows.select("doc_id", F.row_number().over(order).cast("long").alias("place"), "record")


def edge_addition_candidates(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """`doc_id`, `anchor`, `role`, `event_no`: events that an edge from (role source) or to (target) the anchor may join: neither the
    anchor, nor an ancestor (descendant) of it, nor already joined."""
    rows = anchors.select("doc_id", "anchor", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("role")).join(nodes.select("doc_id", "event_no"), "doc_id").where("anchor != event_no")
    barred = [
        pairs.select("doc_id", F.col("j").alias("anchor"), F.col("i").alias("event_no"), F.lit("source").alias("role")),
        edges.select("doc_id", F.col("i").alias("anchor"), F.col("j").alias("event_no"), F.lit("source").alias("role")),
        pairs.select("doc_id", F.col("i").alias("anchor"), F.col("j").alias("event_no"), F.lit("target").alias("role")),
        edges.select("doc_id", F.col("j").alias("anchor"), F.col("i").alias("event_no"), F.lit("target").alias("role")),
    ]
    every = barred[0]
    for b in barred[1:]:
        every = every.unionByName(b)
    return rows.join(every, ["doc_id", "anchor", "event_no", "role"], "left_anti")


def reversible_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges that may be turned round: the reverse isn't there, and no other path leads from i to j."""
    longer = edges.select("doc_id", "i", F.col("j").alias("w")).join(pairs.select("doc_id", F.col("i").alias("w"), "j"), ["doc_id", "w"]).where("w != j").select(*KEY)
    turned = edges.select("doc_id", F.col("j").alias("i"), F.col("i").alias("j"))
    return edges.select(*KEY).distinct().join(longer, KEY, "left_anti").join(turned, KEY, "left_anti")


def apply_review_edits(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """`edges` (doc_id, i, j, edge_type, reason) after delete, retype, reverse and add; touched edges get `manual_review`.

    An edit that needs a reason (retype, add) and has none changes nothing, and neither does the reverse of an edge that mustn't be turned
    round (`reversible_edges`). Of several edits of one edge the last by `edit_no` counts, where there is such a column; else delete goes
    before retype before reverse. Of several additions of one edge the same counts, the first by type.
    """
    valid = edits.where(~F.col("action").isin("retype", "add") | (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    last = [F.desc("edit_no")] if "edit_no" in edits.columns else []
    adds = F.col("action") == "add"
    one = F.row_number().over(Window.partitionBy(*KEY, adds).orderBy(*last, "action", "edge_type", "reason"))
    turned = edges.join(valid.where("action = 'reverse'").select("doc_id").distinct(), "doc_id", "left_semi").select(*KEY)
    may = reversible_edges(turned, reachable_pairs(turned)).withColumn("may", F.lit(True))
    valid = valid.join(may, KEY, "left").where("action != 'reverse' OR may").withColumn("_n", one).where("_n = 1")
    change = valid.where("action != 'add'").select(*KEY, "action", F.col("edge_type").alias("to_type"), F.col("reason").alias("why"))
    rows = edges.join(change, KEY, "left").where("action IS NULL OR action != 'delete'")
    turn, retype = F.col("action").eqNullSafe("reverse"), F.col("action").eqNullSafe("retype")
    rows = rows.select(
        "doc_id", F.when(turn, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turn, F.col("i")).otherwise(F.col("j")).alias("j"),
        F.when(retype, F.col("to_type")).otherwise(F.col("edge_type")).alias("edge_type"), F.when(retype, F.col("why")).otherwise(F.col("reason")).alias("reason"), F.col("action").isNotNull().alias("manual_review"),
    )
    return rows.unionByName(valid.where("action = 'add'").select(*KEY, "edge_type", "reason", F.lit(True).alias("manual_review")))


def trailing_usage(calls: DataFrame, window_us: int, rpm: int, tpm: int) -> DataFrame:
    """`calls` (client, call_id, ts, tokens) with requests and tokens in (t - window, t] and what the limits say of each call.

    `over_rpm`: the prior calls reach the limit; `over_tpm`: prior tokens and the call's own, 1 to the limit, exceed it; a limit of 0 is off.
    Calls of one instant count as prior to one another in order of their id.
    """
    own = F.greatest(F.lit(1), F.least(F.col("tokens"), F.lit(tpm))) if tpm else F.greatest(F.lit(1), F.col("tokens"))
    rows = calls.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    trailing = Window.partitionBy("client").orderBy("us").rangeBetween(-(window_us - 1), 0)
    same = Window.partitionBy("client", "us")
    rows = rows.select("client", "call_id", "us", "tokens", F.count("*").over(trailing).alias("all_n"), F.sum("tokens").over(trailing).alias("all_t"), F.count("*").over(same).alias("same_n"), F.sum("tokens").over(same).alias("same_t"), F.row_number().over(same.orderBy("call_id")).alias("place"), F.sum("tokens").over(same.orderBy("call_id").rowsBetween(Window.unboundedPreceding, 0)).alias("upto_t"))
    n, t = F.col("all_n") - F.col("same_n") + F.col("place"), F.col("all_t") - F.col("same_t") + F.col("upto_t")
    rows = rows.select("client", "call_id", "tokens", n.alias("n_requests"), t.alias("n_tokens"))
    over_tpm = (F.col("n_tokens") - F.col("tokens") + own > tpm) if tpm else F.lit(False)
    return rows.withColumn("over_rpm", (F.col("n_requests") - 1 >= rpm) if rpm else F.lit(False)).withColumn("over_tpm", over_tpm)
