"""Edge curation: cleaning proposals, votes of experts, verdicts of a judge.

Edges are rows of (doc_id, i, j) by event number; raw proposals have string ids `cause`, `effect`. First-seen order is an explicit
`ordinal`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import strip

#: Labels that count as causal for experts and for the judge, the temporal label, known experts.
EXPERT_CAUSAL = ["causal", "casual", "keep", "yes", "true", "因果", "保留"]
JUDGE_CAUSAL = ["causal", "casual", "keep", "yes"]
TEMPORAL = "temporal"
KNOWN_EXPERTS = ["temporal", "precondition", "discourse", "commonsense"]

NO_REASON = "no reason given"
NOT_KEPT = "not kept by the judge"


def _first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def normalize_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trimmed rows with known events, cause before effect, and a reason: columns of `raw`, with `i`, `j` for the ids."""
    event = nodes.select("doc_id", "event_id", "event_no")
    rows = raw.withColumn("cause", strip("cause")).withColumn("effect", strip("effect")).withColumn("reason", strip("reason"))
    rows = rows.where((F.col("cause") != F.col("effect")) & (F.col("reason") != ""))
    rows = rows.join(event.select("doc_id", F.col("event_id").alias("cause"), F.col("event_no").alias("i")), ["doc_id", "cause"])
    rows = rows.join(event.select("doc_id", F.col("event_id").alias("effect"), F.col("event_no").alias("j")), ["doc_id", "effect"])
    out = rows.where("i < j").drop("cause", "effect")
    if "supporters" in raw.columns:
        out = out.withColumn("supporters", F.filter("supporters", lambda s: s.isin(KNOWN_EXPERTS)))
    return out


def dedupe_edges(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each edge by `ordinal`, and `rank`, its place by event numbers in the document (and `by`)."""
    first = _first(edges, ["doc_id", *by, "i", "j"], "ordinal")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", *by).orderBy("i", "j")).cast("long"))


def normalize_proposals(answers: DataFrame) -> DataFrame:
    """The rows of `edges`, or of `causal_edges` where that is empty or missing, with their `ordinal`."""
    chosen = F.when(F.size("edges") > 0, F.col("edges")).otherwise(F.col("causal_edges"))
    rows = answers.select("doc_id", "expert", F.posexplode(chosen).alias("ordinal", "edge"))
    return rows.select("doc_id", "expert", F.col("ordinal").cast("long").alias("ordinal"), "edge.*")


def _kind(label: Column, causal: list[str]) -> Column:
    low = F.lower(strip(label))
    return F.when(low.isin(causal), "causal").when(low == TEMPORAL, "temporal")


def classify_proposals(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers `[cause, effect, label, reason]` for candidates: `doc_id`, `expert`, `i`, `j`, `kind`, `reason`, `ordinal`; of each kind the first."""
    kind = _kind(F.col("label"), EXPERT_CAUSAL)
    out = rows.withColumn("kind", kind).where("kind IS NOT NULL").join(candidates.select("doc_id", "i", "j").distinct(), ["doc_id", "i", "j"], "left_semi")
    out = out.withColumn("reason", F.coalesce(F.nullif(strip("reason"), F.lit("")), F.lit(NO_REASON)))
    return _first(out, ["doc_id", "expert", "kind", "i", "j"], "ordinal").select("doc_id", "expert", "i", "j", "kind", "reason", "ordinal")


def allowed_keys(proposals: DataFrame) -> DataFrame:
    """The distinct edges that any expert proposed."""
    return proposals.select("doc_id", "i", "j").distinct()


def candidate_pool(proposals: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j`, `supporters`, `reasons`, `n_supporters`: each edge's experts and reasons in first-seen order (`expert_no`, `ordinal`)."""
    seen = F.array_sort(F.collect_list(F.struct("expert_no", "ordinal", "expert", "reason")))
    out = proposals.groupBy("doc_id", "i", "j").agg(seen.alias("seen"))
    supporters = F.array_distinct(F.transform("seen", lambda s: s["expert"]))
    reasons = F.transform("seen", lambda s: F.struct(s["expert"].alias("expert"), s["reason"].alias("reason")))
    return out.select("doc_id", "i", "j", supporters.alias("supporters"), reasons.alias("reasons"), F.size(supporters).cast("long").alias("n_supporters"))


def experts_agree(classified: DataFrame, presence: DataFrame, a: str = "discourse", b: str = "commonsense") -> DataFrame:
    """`doc_id`, `agreed`: whether both experts answered (`presence`: doc_id, expert) and have equal causal sets; two empty sets are equal."""
    keys = classified.where((F.col("kind") == "causal") & F.col("expert").isin(a, b)).groupBy("doc_id", "i", "j").agg(F.count_distinct("expert").alias("n"))
    odd = keys.groupBy("doc_id").agg(F.bool_and(F.col("n") == 2).alias("equal"))
    here = presence.where(F.col("expert").isin(a, b)).groupBy("doc_id").agg(F.count_distinct("expert").alias("here"))
    return here.join(odd, "doc_id", "left").select("doc_id", ((F.col("here") == 2) & F.coalesce("equal", F.lit(True))).alias("agreed"))


def judge_verdicts(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j`, `verdict` (kept, temporal, rejected), `reason`, `supporters` for all edges of the pool.

    An edge listed as both stays both. An empty reason gives way to the pool's first one for kept edges, else to a default.
    """
    first_reason = pool.select("doc_id", "i", "j", F.col("reasons")[0]["reason"].alias("pool_reason"), "supporters")
    kinds = rows.withColumn("kind", _kind(F.col("label"), JUDGE_CAUSAL))
    kinds = _first(kinds, ["doc_id", "i", "j", "kind"], "ordinal").withColumn("said", F.nullif(strip("reason"), F.lit("")))
    decided = F.max(F.col("kind").isNotNull().cast("int")).over(Window.partitionBy("doc_id", "i", "j"))
    kinds = kinds.withColumn("decided", decided).where("kind IS NOT NULL OR decided = 0")
    out = first_reason.join(kinds.select("doc_id", "i", "j", "kind", "said"), ["doc_id", "i", "j"], "left")
    verdict = F.when(F.col("kind") == "causal", "kept").when(F.col("kind") == "temporal", "temporal").otherwise("rejected")
    fallback = F.when(F.col("kind") == "causal", F.col("pool_reason")).when(F.col("kind") == "temporal", F.lit(NO_REASON)).otherwise(F.lit(NOT_KEPT))
    return out.select("doc_id", "i", "j", verdict.alias("verdict"), F.coalesce("said", fallback).alias("reason"), "supporters")


def llm_temporal_edges(verdicts: DataFrame, classified: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j`, `priority`, `span`, `reason`: temporal edges of judge (0), discourse (1), commonsense (2), small to large, the
    first of each with its reason."""
    judge = verdicts.where("verdict = 'temporal'").select("doc_id", "i", "j", F.lit(0).alias("priority"), "reason")
    order = F.when(F.col("expert") == "discourse", 1).when(F.col("expert") == "commonsense", 2)
    said = classified.where("kind = 'temporal'").select("doc_id", "i", "j", order.alias("priority"), "reason").where("priority IS NOT NULL")
    rows = judge.unionByName(said).select("doc_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.struct("priority", (F.col("i") > F.col("j")).alias("turned"), "reason").alias("x"))
    rows = rows.groupBy("doc_id", "i", "j").agg(F.min("x").alias("x"))
    return rows.select("doc_id", "i", "j", F.col("x.priority").cast("long").alias("priority"), (F.col("j") - F.col("i")).alias("span"), "x.reason")


def merge_edge_types(causal: DataFrame, temporal: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct edges of both types whose ends exist."""
    rows = causal.select("doc_id", "i", "j").union(temporal.select("doc_id", "i", "j")).distinct()
    known = nodes.select("doc_id", "event_no")
    return rows.join(known.withColumnRenamed("event_no", "i"), ["doc_id", "i"], "left_semi").join(known.withColumnRenamed("event_no", "j"), ["doc_id", "j"], "left_semi").select("doc_id", "i", "j")


def typed_edges(causal: DataFrame, temporal: DataFrame) -> DataFrame:
    """`doc_id`, `src`, `dst`, `rel`: 0 temporal, 1 temporal reversed, 2 causal, 3 causal reversed; types aren't merged."""
    def both(df: DataFrame, rel: int) -> DataFrame:
        ways = F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(rel).alias("rel")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), F.lit(rel + 1).alias("rel")))
        return df.select("doc_id", F.inline(ways))

    return both(temporal, 0).unionByName(both(causal, 2))


def discussion_summary(docs: DataFrame, results: DataFrame, presence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`doc_id`, `summary`: name and text, then for each round from 1 each expert's causal edges, from the second round on the temporal
    ones as well, and the judge's of both kinds; an edge with its reason on each line, "- none" for no edge.

    `docs` has `doc_id`, `doc_name`, `text`; `results` `doc_id`, `round` (from 0), `expert`, `kind`, `i`, `j`, `reason`; `presence`
    `doc_id`, `round`, `expert_no`, `expert` for all that answered; `verdicts` `doc_id`, `i`, `j`, `verdict`, `reason`.
    """
    line = lambda e: F.concat(F.lit("- E"), e["i"].cast("string"), F.lit(" -> E"), e["j"].cast("string"), F.lit("  "), F.coalesce(e["reason"], F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "reason"))), line), "\n").alias("lines")
    kinds = lambda all_of_them: F.explode(F.when(all_of_them, F.array(F.lit("causal"), F.lit("temporal"))).otherwise(F.array(F.lit("causal"))))
    said = results.groupBy("doc_id", "round", "expert", "kind").agg(lines)
    asked = presence.select("doc_id", "round", "expert_no", "expert", kinds(F.col("round") >= 1).alias("kind"))
    parts = asked.join(said, ["doc_id", "round", "expert", "kind"], "left").select("doc_id", "round", "expert_no", "kind", F.format_string("[%s] %s edges\n%s", "expert", "kind", F.coalesce("lines", F.lit("- none"))).alias("part"))
    heads = presence.select("doc_id", "round").distinct().select("doc_id", "round", F.lit(-1).alias("expert_no"), F.lit("").alias("kind"), F.format_string("\nRound %d", F.col("round") + 1).alias("part"))
    decided = verdicts.where("verdict IN ('kept', 'temporal')").withColumn("kind", F.when(F.col("verdict") == "kept", "causal").otherwise("temporal")).groupBy("doc_id", "kind").agg(lines)
    last = docs.select("doc_id", kinds(F.lit(True)).alias("kind")).join(decided, ["doc_id", "kind"], "left")
    last = last.select("doc_id", F.lit(1 << 30).alias("round"), F.lit(0).alias("expert_no"), "kind", F.format_string("Judge %s edges\n%s", "kind", F.coalesce("lines", F.lit("- none"))).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("round", "expert_no", "kind", "part"))), lambda x: x["part"]), "\n")
    body = parts.unionByName(heads).unionByName(last).groupBy("doc_id").agg(joined.alias("body"))
    text = strip("text")
    head = F.concat(F.lit("Document: "), "doc_name", F.when(text != "", F.concat(F.lit("\n\n===== Text =====\n\n"), text)).otherwise(""))
    return docs.select("doc_id", head.alias("head")).join(body, "doc_id").select("doc_id", F.concat_ws("\n", "head", "body").alias("summary"))


def document_status(docs: DataFrame, verdicts: DataFrame, final_edges: DataFrame) -> DataFrame:
    """`doc_id`, `status` (empty_pool, no_edges, done), `n_pool`, `n_kept`, `n_final`."""
    counts = verdicts.groupBy("doc_id").agg(F.count_distinct("i", "j").alias("n_pool"), F.count_if(F.col("verdict") == "kept").alias("n_kept"))
    final = final_edges.groupBy("doc_id").agg(F.count("*").alias("n_final"))
    rows = docs.select("doc_id").join(counts, "doc_id", "left").join(final, "doc_id", "left").na.fill(0, ["n_pool", "n_kept", "n_final"])
    status = F.when(F.col("n_pool") == 0, "empty_pool").when(F.col("n_final") == 0, "no_edges").otherwise("done")
    return rows.select("doc_id", status.alias("status"), "n_pool", "n_kept", "n_final")
