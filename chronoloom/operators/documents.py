"""Document preparation: ids, timelines, validation, digests, token estimates, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of document and event ids, the number of an event id that isn't one, bytes of a token.
DOC_ID = r"^([A-Z]+\d+)"
EVENT_ID = r"^E[0-9]+$"
NO_NUMBER = 1_000_000_000
BYTES_PER_TOKEN = 3.2


#: The characters of Unicode's white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(c, F.lit(WHITE))


def extract_doc_id(name: Column | str) -> Column:
    """The letters and digits at the head of a trimmed name; null if there are none."""
    return F.nullif(F.regexp_extract(strip(name), DOC_ID, 1), F.lit(""))


def event_id_num(event_id: Column | str) -> Column:
    """The number of `E<digits>`, 10**9 for any other id."""
    c = F.col(event_id) if isinstance(event_id, str) else event_id
    return F.when(c.rlike(EVENT_ID), F.substring(c, 2, 18).cast("long")).otherwise(F.lit(NO_NUMBER).cast("long"))


def timeline_events(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id`, `event_no`, `event_id`, `text`: a document's non-blank lines, trimmed, numbered from 1.

    Lines are filtered inside the array, so the rows come out numbered and no shuffle is needed.
    """
    lines = F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("pos", "line"))
    number = (F.col("pos") + 1).cast("long")
    return rows.select("doc_id", number.alias("event_no"), F.concat(F.lit("E"), number.cast("string")).alias("event_id"), F.col("line").alias("text"))


def events_map(nodes: DataFrame) -> DataFrame:
    """`doc_id`, `events`: the map of event ids to texts, in event order."""
    entries = F.array_sort(F.collect_list(F.struct("event_no", "event_id", "text")))
    return nodes.groupBy("doc_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["event_id"], e["text"]))).alias("events"))


def build_documents(cleaned: DataFrame, timeline: DataFrame, doc_ids: list[str] | None = None) -> DataFrame:
    """`doc_name`, `doc_text`, `events` of the ids that both tables (`doc_id`, `text`) have."""
    if doc_ids is not None:
        cleaned = cleaned.where(F.col("doc_id").isin(doc_ids))
    lines = F.filter(F.transform(F.split("text", r"\R"), strip), lambda x: x != "")
    entries = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")), x))
    events = timeline.select("doc_id", F.map_from_entries(entries).alias("events"))
    return cleaned.join(events, "doc_id").select(F.col("doc_id").alias("doc_name"), F.col("text").alias("doc_text"), "events")


def build_summary(cleaned: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row for each side and kind of id: counts, and the ids that either side lacks, as `what`, `n`, `doc_id`."""
    a, b = cleaned.select("doc_id"), timeline.select("doc_id")
    counts = [
        a.agg(F.count("*").alias("n")).select(F.lit("cleaned_count").alias("what"), "n", F.lit(None).cast("string").alias("doc_id")),
        b.agg(F.count("*").alias("n")).select(F.lit("timeline_count").alias("what"), "n", F.lit(None).cast("string").alias("doc_id")),
        a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("written_docs").alias("what"), "n", F.lit(None).cast("string").alias("doc_id")),
        a.join(b, "doc_id", "left_anti").select(F.lit("missing_in_timeline").alias("what"), F.lit(1).cast("long").alias("n"), "doc_id"),
        b.join(a, "doc_id", "left_anti").select(F.lit("missing_in_cleaned").alias("what"), F.lit(1).cast("long").alias("n"), "doc_id"),
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def validate_documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (`doc_name`, `doc_text`, `events`) trimmed, events in number order as `event_list`, and `error`: the first rule that
    fails, null for a valid document; with the columns of `keep`."""
    entries = F.map_entries(F.coalesce("events", F.create_map().cast("map<string,string>")))
    error = (
        F.when(F.coalesce(strip("doc_name"), F.lit("")) == "", "blank name")
        .when(F.coalesce(strip("doc_text"), F.lit("")) == "", "blank text")
        .when(F.size(entries) == 0, "no events")
        .when(F.exists(entries, lambda e: ~F.coalesce(strip(e["key"]).rlike(EVENT_ID), F.lit(False))), "bad event id")
        .when(F.exists(entries, lambda e: F.coalesce(strip(e["value"]), F.lit("")) == ""), "blank event text")
    )
    listed = F.array_sort(F.transform(entries, lambda e: F.struct(event_id_num(strip(e["key"])).alias("event_no"), strip(e["key"]).alias("event_id"), strip(e["value"]).alias("text"))))
    return docs.select(*keep, strip("doc_name").alias("doc_name"), strip("doc_text").alias("doc_text"), listed.alias("event_list"), error.alias("error"))


def forward_pairs(nodes: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j` with i < j: the pairs that a legal edge may join. Grows with the square of a document's events."""
    a = nodes.select("doc_id", F.col("event_no").alias("i"))
    b = nodes.select("doc_id", F.col("event_no").alias("j"))
    return a.join(b, "doc_id").where("i < j")


def text_list_hash(nodes: DataFrame) -> DataFrame:
    """`doc_id`, `hash`: md5 of the events' texts in order, a newline between."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("event_no", "text"))), lambda e: e["text"])
    return nodes.groupBy("doc_id").agg(F.md5(F.array_join(texts, "\n")).alias("hash"))


def source_hash(content: Column | str) -> Column:
    """sha256 of a file's bytes."""
    return F.sha2(content, 256)


def estimate_tokens(text: Column | str) -> Column:
    """0 for an empty or null text, else the bytes over 3.2, rounded up, 1 at least."""
    n = F.coalesce(F.octet_length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / BYTES_PER_TOKEN))).cast("long")


def estimate_chat_tokens(messages: Column | str) -> Column:
    """Tokens of an array of (role, content): 12, and for each message 6 and those of both parts; 1 at least."""
    total = F.aggregate(messages, F.lit(12).cast("long"), lambda acc, m: acc + F.lit(6).cast("long") + estimate_tokens(m["role"]) + estimate_tokens(m["content"]))
    return F.greatest(F.lit(1).cast("long"), total)


def usage_total_tokens(payload: Column | str) -> Column:
    """Tokens that a usage JSON states: `total_tokens` if positive, else prompt and completion if both are not negative and
    their sum is positive, else null."""
    u = F.from_json(payload, "total_tokens long, prompt_tokens long, completion_tokens long")
    both = u["prompt_tokens"] + u["completion_tokens"]
    return F.when(u["total_tokens"] > 0, u["total_tokens"]).when((u["prompt_tokens"] >= 0) & (u["completion_tokens"] >= 0) & (both > 0), both)


def render_template(template: Column | str, values: dict[str, Column]) -> Column:
    """The template with each `{{KEY}}` replaced, in the order of `values`."""
    out = F.col(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value)
    return out


#: Experts of each round and what each looks for.
EXPERTS = [
    (0, 0, "temporal", "You order events in time and name pairs where the earlier one leads to the later one."),
    (0, 1, "precondition", "You name pairs where the first event makes the second one possible."),
    (1, 2, "discourse", "You judge by what the text states whether each pair is causal, temporal or neither."),
    (1, 3, "commonsense", "You judge by general knowledge whether each pair is causal, temporal or neither."),
]
JUDGE = "You are the judge. You keep pairs of the pool that the text gives proof of, call others temporal, and add none."
#: What free proposals have to look like; it stands behind the role.
SCHEMA = "Answer with one JSON object alone. Keys and strings have double quotes, there are no further keys, a reason is short, and a cause has a smaller number than its effect."
#: Prompts with places for each document's values.
FIRST_USER = 'Expert {{EXPERT}}, round {{ROUND}}.\n\nDocument {{ID}}: {{NAME}}\n\nEvents in order of time:\n{{EVENTS}}{{HISTORY}}\n\nText:\n{{DOC}}\n\nAnswer: {"expert": "{{EXPERT}}", "edges": [{"cause": "E1", "effect": "E3", "reason": "..."}]}'
LATER_USER = 'Expert {{EXPERT}}, round {{ROUND}}.\n\nDocument {{ID}}: {{NAME}}\n\nCandidates, of which each is to be called causal or temporal, and no other:\n{{CANDIDATES}}\n\nText:\n{{DOC}}\n\nAnswer: {"edge1": ["E1", "E3", "causal", "reason"]}'
NO_CANDIDATES = "(there are no candidates)"
JUDGE_USER = 'Document {{ID}}: {{NAME}}\n\nEvents in order of time:\n{{EVENTS}}\n\nCandidates of all experts:\n{{CANDIDATES}}\n\nText:\n{{DOC}}\n\nAnswer for each: {"edge1": ["E1", "E3", "causal", "reason"]}'
HISTORY = "\n\nDecide which pairs to keep, with the others' views in mind.{{OWN}}\n\nResults of the other experts of the round before:\n{{PEERS}}"
OWN_HISTORY = "\n\nYour result of the round before:\n{{RESULT}}"


def _listed(nodes: DataFrame) -> DataFrame:
    """`doc_id`, `listed`: a document's events (event_no, event_id, text) in order."""
    return nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("event_no", "event_id", "text"))).alias("listed"))


def _as_json(listed: Column) -> Column:
    return F.to_json(F.transform(listed, lambda e: F.struct(e["event_id"].alias("event_id"), e["text"].alias("text"))))


def events_json(nodes: DataFrame) -> DataFrame:
    """`doc_id`, `events`: JSON list of a document's events with ids and texts, in order."""
    return _listed(nodes).select("doc_id", _as_json(F.col("listed")).alias("events"))


def _numbered(entries: DataFrame) -> DataFrame:
    """`doc_id`, `candidates`, `n_candidates`: a JSON object of `json` (doc_id, edge, json) under the keys edge1, edge2, ... in order."""
    keyed = F.concat(F.lit('"edge'), F.col("edge").cast("string"), F.lit('":'), F.col("json"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("edge", keyed.alias("json")))), lambda e: e["json"])
    return entries.groupBy("doc_id").agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("candidates"), F.count("*").alias("n_candidates"))


def _pairs_with_text(pairs: Column, listed: Column) -> Column:
    """A JSON object of the pairs (i, j), in order, with both events' texts under their ids, keys edge1, edge2, ...; null if there are none. Texts are
    looked up inside the document: at their number's place if events are numbered without a gap, else among all."""
    at = lambda k: F.get(listed, (k - F.get(listed, F.lit(0))["event_no"]).cast("int"))
    event = lambda k: F.when(at(k)["event_no"] == k, at(k)).otherwise(F.get(F.filter(listed, lambda e: e["event_no"] == k), F.lit(0)))
    both = F.transform(F.array_sort(pairs), lambda p: F.struct(event(p["i"]).alias("a"), event(p["j"]).alias("b")))
    known = F.filter(both, lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    text = lambda x: F.to_json(F.map_from_arrays(F.array(x["a"]["event_id"], x["b"]["event_id"]), F.array(x["a"]["text"], x["b"]["text"])))
    keyed = F.transform(known, lambda x, k: F.concat(F.lit('"edge'), (k + 1).cast("string"), F.lit('":'), text(x)))
    return F.when(F.size(keyed) > 0, F.concat(F.lit("{"), F.array_join(keyed, ","), F.lit("}")))


def result_json(results: DataFrame) -> DataFrame:
    """`doc_id`, `round`, `expert`, `result`: each expert's edges (`kind` causal or temporal, `i`, `j`, `reason`) as one JSON object; the temporal
    ones are named only if there are any."""
    name = lambda c: F.concat(F.lit("E"), F.col(c).cast("string"))
    edge = F.struct(F.col("i"), F.col("j"), F.struct(name("i").alias("cause"), name("j").alias("effect"), F.col("reason")).alias("edge"))
    listed = lambda kind: F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, edge))), lambda e: e["edge"]))
    rows = results.groupBy("doc_id", "round", "expert").agg(listed("causal").alias("causal"), listed("temporal").alias("temporal"))
    more = F.when(F.col("temporal") != "[]", F.concat(F.lit(',"temporal_edges":'), "temporal")).otherwise("")
    return rows.select("doc_id", "round", "expert", F.concat(F.lit('{"expert":"'), "expert", F.lit('","causal_edges":'), "causal", more, F.lit("}")).alias("result"))


def history_blocks(results: DataFrame) -> DataFrame:
    """`doc_id`, `round`, `expert`, `history`: what each expert of a round is told of the round before: their own result, if they took part,
    and those of the others."""
    experts = F.broadcast(results.sparkSession.createDataFrame([(r, e) for r, _, e, _ in EXPERTS if r], "round int, expert string"))
    said = result_json(results).select("doc_id", (F.col("round") + 1).alias("round"), F.col("expert").alias("by"), "result")
    rows = said.join(experts, "round")
    other = F.when(F.col("by") != F.col("expert"), F.struct("by", F.concat(F.lit('"'), "by", F.lit('":'), "result").alias("json")))
    peers = F.transform(F.array_sort(F.collect_list(other)), lambda x: x["json"])
    rows = rows.groupBy("doc_id", "round", "expert").agg(F.max(F.when(F.col("by") == F.col("expert"), F.col("result"))).alias("own"), F.concat(F.lit("{"), F.array_join(peers, ","), F.lit("}")).alias("peers"))
    own = F.when(F.col("own").isNull(), "").otherwise(render_template(F.lit(OWN_HISTORY), {"RESULT": F.col("own")}))
    return rows.select("doc_id", "round", "expert", render_template(F.lit(HISTORY), {"OWN": own, "PEERS": F.col("peers")}).alias("history"))


def _shown(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_name", F.lit("")).alias("doc_name"), F.coalesce("text", F.lit("")).alias("doc"))


def expert_prompts(docs: DataFrame, nodes: DataFrame, candidates: DataFrame | None, results: DataFrame | None = None) -> DataFrame:
    """`doc_id`, `round`, `expert`, `system_prompt`, `user_prompt`: one row for each document and expert. No call is made.

    `docs` has `doc_id`, `doc_name`, `text`; `candidates` has `doc_id`, `i`, `j`. Round 0 proposes freely: role and schema, then all events. Later
    rounds judge the candidates: the role alone, then both events of each pair. Without a table of candidates they propose freely
    as well and are told the `results` of the round before. The experts are a fixed table of four rows.
    """
    experts = F.broadcast(docs.sparkSession.createDataFrame(EXPERTS, "round int, expert_no int, expert string, role string"))
    # all of a document meets in one row before it is told to each expert, so texts are dealt once
    rows = _shown(docs).join(_listed(nodes), "doc_id")
    none = F.lit(None).cast("string")
    if candidates is not None:
        pairs = candidates.groupBy("doc_id").agg(F.collect_set(F.struct("i", "j")).alias("pairs"))
        rows = rows.join(pairs, "doc_id", "left").withColumn("candidates", _pairs_with_text(F.col("pairs"), F.col("listed")))
    elif results is not None:
        told = history_blocks(results).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("round", "expert"), "history"))).alias("told"))
        rows = rows.join(told, "doc_id", "left")
    rows = rows.withColumn("events", _as_json(F.col("listed"))).drop("listed").crossJoin(experts)
    free = F.lit(True) if candidates is None else F.col("round") == 0
    rows = rows.withColumn("history", F.try_element_at("told", F.struct("round", "expert")) if "told" in rows.columns else none)
    rows = rows if candidates is not None else rows.withColumn("candidates", none)
    known = {"EXPERT": F.col("expert"), "ROUND": (F.col("round") + 1).cast("string"), "ID": F.col("doc_id").cast("string"), "NAME": F.col("doc_name")}
    first = render_template(F.lit(FIRST_USER), known | {"EVENTS": F.col("events"), "HISTORY": F.coalesce("history", F.lit("")), "DOC": F.col("doc")})
    later = render_template(F.lit(LATER_USER), known | {"CANDIDATES": F.coalesce("candidates", F.lit(NO_CANDIDATES)), "DOC": F.col("doc")})
    system = F.when(free, F.concat("role", F.lit("\n\n" + SCHEMA))).otherwise(F.col("role"))
    return rows.select("doc_id", "round", "expert", system.alias("system_prompt"), F.when(free, first).otherwise(later).alias("user_prompt"))


def judge_prompts(docs: DataFrame, nodes: DataFrame, proposals: DataFrame) -> DataFrame:
    """`doc_id`, `n_candidates`, `system_prompt`, `user_prompt`: each document with its candidates, without their experts, numbered as first
    seen (`expert_no`, then `ordinal`)."""
    seen = proposals.groupBy("doc_id", "i", "j").agg(F.min(F.struct("expert_no", "ordinal")).alias("first"))
    edge = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "i", "j"))
    name = lambda c: F.concat(F.lit("E"), F.col(c).cast("string"))
    pool = _numbered(seen.select("doc_id", edge.alias("edge"), F.to_json(F.array(name("i"), name("j"))).alias("json")))
    rows = _shown(docs).join(events_json(nodes), "doc_id").join(pool, "doc_id")
    user = render_template(F.lit(JUDGE_USER), {"ID": F.col("doc_id").cast("string"), "NAME": F.col("doc_name"), "EVENTS": F.col("events"), "CANDIDATES": F.col("candidates"), "DOC": F.col("doc")})
    return rows.select("doc_id", "n_candidates", F.lit(JUDGE).alias("system_prompt"), user.alias("user_prompt"))
