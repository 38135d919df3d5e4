"""Scores of events, their normalization and ranking, and scoring with given weights.

`scores` tables are (doc_id, event_no, event_id, score). Ties between event ids go by the id as a string, so E10 stands before E2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from chronoloom.functions import batches as bt
from chronoloom.functions.storage import stored

from .documents import strip
from .graphs import FEATURES, node_features

#: Rank of a missing score, length of a shown text, ends of the colour scale, width of a label, weights of the formula.
NO_RANK = 999
SHOWN = 16
LOW_RGB, HIGH_RGB = (219, 238, 255), (214, 39, 40)
LABEL_WIDTH = 14
W_RICH, W_RARE = 1.0, 0.3
EPS = 1e-6
#: Places that scores are rounded to before ties are ranked.
PLACES = 9


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


# ranks and scales


def competition_rank(scores: DataFrame) -> DataFrame:
    """`rank`: ties share the best place, a gap follows."""
    return scores.withColumn("rank", F.rank().over(_doc().orderBy(F.desc("score"))).cast("long"))


def unique_rank(scores: DataFrame) -> DataFrame:
    """`rank`: no ties; equal scores go by event id as a string."""
    return scores.withColumn("rank", F.row_number().over(_doc().orderBy(F.desc("score"), "event_id")).cast("long"))


def scale_scores(scores: DataFrame, how: str, before: str = "none") -> DataFrame:
    """`scaled`: zscore, minmax, sigmoid or none, in each document; a sigmoid may stand behind a zscore or minmax, `before`. A single event's
    sample deviation counts as 0."""
    if before != "none":
        if how != "sigmoid" or before == "sigmoid":
            raise ValueError(f"{before} can't come before {how}")
        rows = scale_scores(scores, before)
        return rows.withColumn("scaled", 1 / (1 + F.exp(-F.col("scaled"))))
    s = F.col("score")
    made = {
        "zscore": (s - F.avg(s).over(_doc())) / (F.coalesce(F.stddev_samp(s).over(_doc()), F.lit(0.0)) + EPS),
        "minmax": (s - F.min(s).over(_doc())) / (F.max(s).over(_doc()) - F.min(s).over(_doc()) + EPS),
        "sigmoid": 1 / (1 + F.exp(-s)),
        "none": s,
    }
    return scores.withColumn("scaled", made[how])


def degree_norm(degree: DataFrame, how: str) -> DataFrame:
    """`norm`: the degree, 1 at least, over the document's largest, as it is (max), as log1p (log), as a root (sqrt); else 0."""
    d = F.greatest(F.lit(1.0), F.col("degree").cast("double"))
    value = {"max": d, "log": F.log1p(d), "sqrt": F.sqrt(d)}.get(how)
    return degree.withColumn("norm", F.lit(0.0) if value is None else value / (F.max(value).over(_doc()) + EPS))


# semantic scores


def _norm(c: str) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def richness(vectors: DataFrame) -> DataFrame:
    """`rich`: the length of the vector."""
    return vectors.select("doc_id", "event_no", _norm("embedding").alias("rich"))


#: Events of a document up to which its vectors are in one task, and numbers of vectors that are worked on together.
RARITY_EVENTS = 1 << 16


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows of a flat array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _rare(u: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From unit vectors, their documents' sums and sizes."""
    return np.where(n > 1, 1 - ((u * total).sum(axis=1) - (u * u).sum(axis=1)) / np.maximum(1, n - 1), 0.0)


def rarity(vectors: DataFrame) -> DataFrame:
    """`rare`: the mean of 1 - cosine to the document's other events, 0 for a single event.

    With unit vectors u and their sum S it is 1 - (u.S - u.u) / (N - 1), so the work is linear in the events and no pairs are made. A
    document's vectors meet in one task after one shuffle; those of more than `RARITY_EVENTS` events are summed where they are, by
    batch and then by document, and meet the sum alone.
    """
    rows = vectors.select("doc_id", "event_no", "embedding")
    large = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > RARITY_EVENTS).select("doc_id"))

    def work(table: pa.Table) -> pa.Table:
        head = bt.runs_of(bt.places(table))
        u, n = _units(_matrix(table.column("embedding"))), np.diff(head)
        total = np.add.reduceat(u, head[:-1], axis=0)
        return table.select(["doc_id", "event_no"]).append_column("rare", pa.array(_rare(u, np.repeat(total, n, axis=0), np.repeat(n, n))))

    schema = "doc_id long, event_no long, rare double"
    if not large.head(1):
        return bt.whole_documents(rows, work, schema)
    out = bt.whole_documents(rows.join(large, "doc_id", "left_anti"), work, schema)
    return out.unionByName(_rarity_by_sums(rows.join(large, "doc_id", "left_semi")))


def _rarity_by_sums(rows: DataFrame) -> DataFrame:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                docs, first, own = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), _lists(bt.segment_sum(_units(_matrix(batch.column(1))), own, len(docs)), np.ones(len(docs), bool)), pa.array(np.bincount(own))], names=["doc_id", "total", "n"])

    def add(table: pa.Table) -> pa.Table:
        head = bt.runs_of(bt.places(table))[:-1]
        total = np.add.reduceat(_matrix(table.column("total")), head, axis=0)
        return pa.table([table.column("doc_id").combine_chunks().take(pa.array(head)), _lists(total, np.ones(len(head), bool)), pa.array(np.add.reduceat(table.column("n").to_numpy(), head))], ["doc_id", "total", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rare = _rare(_units(_matrix(batch.column(2))), _matrix(batch.column(3)), batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rare)], names=["doc_id", "event_no", "rare"])

    sums = "doc_id long, total array<double>, n long"
    total = bt.whole_documents(rows.select("doc_id", "embedding").mapInArrow(partial, sums), add, sums, together=1 << 12)
    return rows.join(total, "doc_id").select("doc_id", "event_no", "embedding", "total", "n").mapInArrow(meet, "doc_id long, event_no long, rare double")


def semantic_scores(rich: DataFrame, rare: DataFrame, w_rich: float = W_RICH, w_rare: float = W_RARE) -> DataFrame:
    """`score`, `rich`, `rare`: the weighted sum and both parts, scaled to [0, 1] in the document, to 6 places."""
    rows = rich.join(rare, ["doc_id", "event_no"]).withColumn("score", w_rich * F.col("rich") + w_rare * F.col("rare"))
    out = {}
    for c in ("score", "rich", "rare"):
        low, high = F.min(c).over(_doc()), F.max(c).over(_doc())
        out[c] = F.round(F.when(high - low < 1e-8, 0.0).otherwise((F.col(c) - low) / (high - low)), 6)
    return rows.withColumns(out).select("doc_id", "event_no", "score", "rich", "rare")


def semantic_ranking(scores: DataFrame) -> DataFrame:
    """`rank` by score, ties in event order."""
    return scores.withColumn("rank", F.row_number().over(_doc().orderBy(F.desc("score"), "event_no")).cast("long"))


# topology and semantics together


def combined_scores(topo: DataFrame, sem: DataFrame, w_topo: float = 0.5, w_sem: float = 0.5) -> DataFrame:
    """Both scores of each event that has either, their weighted sum and its unique `combined_rank`; a missing score is 0, its rank 999."""
    t = topo.select("doc_id", "event_id", F.col("score").alias("topo_score"), F.col("rank").alias("topo_rank"))
    s = sem.select("doc_id", "event_id", F.col("score").alias("sem_score"), F.col("rank").alias("sem_rank"), *[F.col(c) if c in sem.columns else F.lit(0.0).alias(c) for c in ("rich", "rare")])
    rows = t.join(s, ["doc_id", "event_id"], "full_outer").na.fill(0.0, ["topo_score", "sem_score", "rich", "rare"]).na.fill(NO_RANK, ["topo_rank", "sem_rank"])
    rows = rows.withColumn("combined", w_topo * F.col("topo_score") + w_sem * F.col("sem_score")).withColumn("w_rich", F.lit(W_RICH)).withColumn("w_rare", F.lit(W_RARE))
    return rows.withColumn("combined_rank", F.row_number().over(_doc().orderBy(F.desc("combined"), "event_id")).cast("long"))


def key_node_table(nodes: DataFrame, topo: DataFrame, sem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The combined ranking with texts cut to 16, of documents that all three tables have; and the others with what they lack."""
    have = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    docs = have(nodes, "graph").join(have(topo, "topology"), "doc_id", "full_outer").join(have(sem, "semantic"), "doc_id", "full_outer")
    lacks = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in ("graph", "topology", "semantic")])
    docs = docs.select("doc_id", lacks.alias("missing"))
    good = docs.where("missing = ''").select("doc_id")
    rows = combined_scores(topo.join(good, "doc_id", "left_semi"), sem.join(good, "doc_id", "left_semi"))
    shown = F.when(F.char_length("text") > SHOWN, F.concat(F.substring("text", 1, SHOWN), F.lit("…"))).otherwise(F.col("text"))
    table = rows.join(nodes.select("doc_id", "event_id", shown.alias("shown")), ["doc_id", "event_id"], "left")
    return table.select("doc_id", "combined_rank", "event_id", "shown", "combined", "topo_score", "sem_score", "topo_rank", "sem_rank"), docs.where("missing != ''")


def reweight(scores: DataFrame, weights: list[float]) -> DataFrame:
    """`w_topo`, `combined`, `rank` for each weight of a small grid."""
    rows = scores.select("doc_id", "event_id", "topo_score", "sem_score", F.explode(F.array(*[F.lit(w) for w in weights])).alias("w_topo"))
    rows = rows.withColumn("combined", F.col("w_topo") * F.col("topo_score") + (1 - F.col("w_topo")) * F.col("sem_score"))
    order = Window.partitionBy("doc_id", "w_topo").orderBy(F.desc("combined"), "event_id")
    return rows.select("doc_id", "event_id", "w_topo", "combined", F.row_number().over(order).cast("long").alias("rank"))


def score_color(score: Column | str) -> Column:
    """The colour of a score on the scale, as #rrggbb."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) if isinstance(score, str) else score))
    return F.format_string("#%02x%02x%02x", *[(F.lit(float(a)) + (b - a) * c).cast("int") for a, b in zip(LOW_RGB, HIGH_RGB, strict=True)])


def node_label(event_id: Column, text: Column, score: Column, rank: Column) -> Column:
    """`E3: text` in lines of 14, the text trimmed and its newlines blanks, then the score with two places and the rank."""
    body = F.regexp_replace(F.concat(event_id, F.lit(": "), F.regexp_replace(strip(text), "\n", " ")), "(?s)(.{" + str(LABEL_WIDTH) + "})(?=.)", "$1\n")
    return F.concat(body, F.format_string("\n▲ %.2f (#%d)", score, rank))


def short_label(event_id: Column, score: Column) -> Column:
    """The id and the score with two places behind a star."""
    return F.concat(event_id, F.lit(" ★"), F.format_string("%.2f", score))


def strip_doc_suffix(name: Column | str) -> Column:
    """Without `.txt` at the end, in any case."""
    return F.regexp_replace(name, r"(?i)\.txt$", "")


def score_profile(scores: DataFrame) -> DataFrame:
    """Extremes, mean, deviation, range and shares of small and large scores of each document."""
    s = F.col("score")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return scores.groupBy("doc_id").agg(F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), (F.max(s) - F.min(s)).alias("range"), share(s == 0).alias("share_zero"), share(s < 0.05).alias("share_small"), share(s > 0.95).alias("share_large"))


# scoring with given weights


def _leaky(x: np.ndarray, slope: float) -> np.ndarray:
    return np.where(x >= 0, x, slope * x)


def mlp_scores(features: DataFrame, layers: list[tuple[list[list[float]], list[float]]]) -> DataFrame:
    """`score` of each event: linear layers (rows of weights, biases) with ReLU between and LeakyReLU(0.1) at the end."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[FEATURES].to_numpy(float)
            for n, (w, b) in enumerate(layers):
                x = x @ np.array(w).T + np.array(b)
                x = np.maximum(x, 0) if n < len(layers) - 1 else _leaky(x, 0.1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "event_no": pdf["event_no"], "score": x[:, 0]})

    return features.mapInPandas(run, "doc_id long, event_no long, score double")


#: What a helper makes of many graphs: from values (events by width), sources, targets and kinds of edges, new values and weights.
Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Numbers of the widest vectors that are worked on together.
VALUES_TOGETHER = 4 << 20


def _lists(values: np.ndarray, good: np.ndarray) -> pa.Array:
    """Rows of numbers as lists, null where not `good`; `values` has the good rows alone."""
    ends = np.concatenate([[0], np.cumsum(good) * values.shape[1]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values, float).ravel()), mask=pa.array(~good))


def _on_graphs(h: DataFrame, edges: DataFrame, work: Work, width: int, widest: int = 1) -> DataFrame:
    """`doc_id`, `event_no`, `y` and `weights` (arrays), `error`: `work` on the values `x` of the events of many documents at once, and on
    their edges (`i` to `j` of kind `rel`), of which those with an unknown end are left out.

    Vectors stay flat arrays, edges are places in them; graphs of different documents share no edge. The events of a document with a vector of
    another width than `width`, or none, have a message beside them, and the other documents go on. A document's vectors are in one task;
    `widest` is the widest that `work` makes of one.
    """

    def run(table: pa.Table) -> pa.Table:
        g = bt.graphs_of(table)
        at = np.flatnonzero(g.rows >= 0)
        x = table.column("x").combine_chunks().take(pa.array(g.rows[at]))
        size = x.value_lengths().fill_null(-1).to_numpy()
        bad = np.isin(g.graph[at], np.unique(g.graph[at][size != width]))
        place = np.full(g.n, -1)
        place[at[~bad]] = np.arange((~bad).sum())
        src, dst = place[g.src], place[g.dst]
        known = (src >= 0) & (dst >= 0)
        values = x.filter(pa.array(~bad)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        rel = table.column("rel").combine_chunks().take(pa.array(g.edge_rows[known])).to_numpy(zero_copy_only=False)
        y, weights = work(values, src[known], dst[known], rel)
        message = [f"vectors of {width} numbers are needed, here is one of {n}" if b and n != width else "another event's vector has another width" if b else None for b, n in zip(bad, size, strict=True)] if bad.any() else [None] * len(at)
        return pa.table([*g.ids(at), _lists(y, ~bad), _lists(weights, ~bad), pa.array(message, pa.string())], ["doc_id", "event_no", "y", "weights", "error"])

    rows = bt.tagged(h, edges, "x", "rel")
    return bt.whole_documents(rows, run, "doc_id long, event_no long, y array<double>, weights array<double>, error string", together=max(256, min(bt.TOGETHER, VALUES_TOGETHER // max(1, width, widest))))


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", "i", "j", F.lit(0).alias("rel"))


def _softmax(logit: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Shares of the edges into each event."""
    p = np.exp(logit - bt.segment_max(logit, dst, n)[dst])
    return p / bt.segment_sum(p, dst, n)[dst]


def _attend(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, a: np.ndarray) -> np.ndarray:
    """One layer: heads with `w` (head, output, input) and `a` (head, source's outputs then target's), side by side."""
    heads, size = w.shape[:2]
    wh = np.einsum("ni,hfi->nhf", x, w)
    logit = _leaky((wh * a[:, :size]).sum(-1)[src] + (wh * a[:, size:]).sum(-1)[dst], 0.2)
    out = bt.segment_sum(_softmax(logit, dst, len(x))[:, :, None] * wh[src], dst, len(x))
    return _leaky(out, 0.01).reshape(len(x), heads * size)


Layer = tuple[list[list[list[float]]], list[list[float]]]


def attention_aggregate(h: DataFrame, edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """`doc_id`, `event_no`, `x` (array), `error`: `h` (doc_id, event_no, x) through attention layers, one after the other.

    Each head has LeakyReLU(0.2) logits of both ends over an event's in-edges, softmax, the weighted sum of the sources, and LeakyReLU(0.01);
    heads stand side by side. An event without in-edges gets zeros.
    """
    made = [(np.array(w, float), np.array(a, float)) for w, a in layers]

    def work(x: np.ndarray, src: np.ndarray, dst: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for w, a in made:
            x = _attend(x, src, dst, w, a)
        return x, np.zeros((len(x), 0))

    widest = max(w.shape[0] * w.shape[1] for w, _ in made)
    return _on_graphs(h, _plain(edges), work, made[0][0].shape[2], widest).select("doc_id", "event_no", F.col("y").alias("x"), "error")


def influence_score(h: DataFrame, edges: DataFrame, p: list[float], b: float, norm: str = "max", scale: str = "none", before: str = "none") -> DataFrame:
    """`score` from an event's own values `x` (array) and those of its predecessors: a local part, x times the mean with them, plus the scaled
    degree; and a global part, p times the sum with them over degree + 1, plus b; together scaled by `scale_scores`."""
    weights = np.array(p, float)

    def work(x: np.ndarray, src: np.ndarray, dst: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        into, out = np.bincount(dst, minlength=len(x)), np.bincount(src, minlength=len(x))
        near = bt.segment_sum(x[src], dst, len(x))
        local = (x * (near + x) / (into + 1)[:, None]).sum(axis=1)
        wide = (x + near) / (np.maximum(1, into + out) + 1)[:, None] @ weights + b
        return (local + wide)[:, None], (into + out)[:, None].astype(float)

    rows = _on_graphs(h, _plain(edges), work, len(weights)).select("doc_id", "event_no", F.col("y")[0].alias("raw"), F.col("weights")[0].alias("degree"), "error")
    rows = degree_norm(rows, norm).withColumn("score", F.col("raw") + F.col("norm"))
    return scale_scores(rows, scale, before).select("doc_id", "event_no", F.col("scaled").alias("score"), "error")


#: Small fixed parameters, for tests and for the queries: no weights are given from outside.
PARAMS = {
    "layers": [([[0.3, -0.1, 0.2, 0.2, 0.5, -0.4, 0.1, 0.1, 0.6, 0.2, 0.2], [-0.2, 0.4, 0.1, 0.3, 0.2, 0.1, -0.3, 0.2, 0.5, 0.1, -0.1]], [0.05, -0.02]), ([[0.7, 0.6]], [0.1])],
    "attention": [
        ([[[0.8], [0.5]], [[-0.6], [0.9]]], [[0.5, 0.3, -0.2, 0.1], [0.4, -0.3, 0.6, 0.2]]),
        ([[[0.9, -0.4, 0.6, 0.2]], [[0.3, 0.7, -0.1, 0.5]]], [[0.7, -0.5], [0.2, 0.4]]),
        ([[[1.1, 0.2], [0.4, -0.8]]], [[0.3, 0.6, -0.4, 0.5]]),
    ],
    "influence": ([0.6, -0.3], 0.1),
}


def score_graphs(nodes: DataFrame, edges: DataFrame, params: dict | None = None) -> DataFrame:
    """`doc_id`, `event_no`, `score`, `rank`, `error`: features, layers, attention layers, influence, competition rank.

    Scores are rounded to 9 places before they are ranked, so sums in another order tie all the same. A document whose layers fail
    has the message as `error` and no score; the others go on.
    """
    params = params or PARAMS
    h = mlp_scores(node_features(nodes, edges), params["layers"]).select("doc_id", "event_no", F.array("score").alias("x"))
    h = stored(attention_aggregate(h, edges, params["attention"]))
    scores = influence_score(h.where("error IS NULL").select("doc_id", "event_no", "x"), edges, *params["influence"])
    ranked = competition_rank(scores.withColumn("score", F.round("score", PLACES)).where("error IS NULL"))
    bad = h.where("error IS NOT NULL").select("doc_id", "event_no", "error").union(scores.where("error IS NOT NULL").select("doc_id", "event_no", "error"))
    return ranked.select("doc_id", "event_no", "score", "rank", "error").unionByName(bad, allowMissingColumns=True)


def _elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def _relate(x: np.ndarray, src: np.ndarray, dst: np.ndarray, rel: np.ndarray, layer: dict, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """One layer of attention by relation: new values, and the weights of the relations for each event."""
    w, a, heads = layer["w"], layer["a"], layer["heads"]
    own = np.einsum("ni,rio->nro", x, w)  # each relation projects by itself
    parts = own.reshape(len(x), len(w), heads, -1)
    into = np.zeros_like(parts)
    half = a.shape[1] // 2
    for r in range(len(w)):
        s, d = src[rel == r], dst[rel == r]
        p = np.exp(np.minimum(_leaky((parts[:, r] @ a[r, :half])[s] + (parts[:, r] @ a[r, half:])[d], 0.2), 10))
        share = p / (bt.segment_sum(p, d, len(x)) + 1e-12)[d]
        into[:, r] = bt.segment_sum(share[:, :, None] * parts[s, r], d, len(x))
    channel = into.reshape(own.shape) + own
    logit = _elu(channel @ layer["proj"].T + layer["bias"]) @ layer["q"]
    mix = np.exp(logit - logit.max(axis=1, keepdims=True))
    mix /= mix.sum(axis=1, keepdims=True)
    y = (channel * mix[:, :, None]).sum(axis=1)
    return (y.reshape(len(x), heads, -1).mean(axis=1) if last else y), mix


def relation_attention(vectors: DataFrame, typed: DataFrame, layers: list[dict]) -> DataFrame:
    """`doc_id`, `event_no`, `y` (array), `weights` (array of 4), `error`: attention by relation, then over relations, in layers.

    A layer has for each relation a projection `w` (relation, input, heads x outputs) and `a` (relation, 2 x outputs), `proj`, `bias`
    and `q` of the weights over relations, and `heads`. In each relation: LeakyReLU(0.2) logits up to 10 over an event's in-edges, sums over
    denominators + 1e-12, plus the event's own projection. The relations are mixed by a softmax of q times ELU of their projection. Heads
    stand side by side, with an ELU between layers; the last layer takes their mean, and its weights are returned.
    """
    made = [{k: v if k == "heads" else np.array(v, float) for k, v in layer.items()} for layer in layers]

    def work(x: np.ndarray, src: np.ndarray, dst: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mix = np.zeros((len(x), 4))
        for n, layer in enumerate(made):
            last = n == len(made) - 1
            x, mix = _relate(x, src, dst, rel, layer, last)
            x = x if last else _elu(x)
        return x, mix

    ends = typed.select("doc_id", F.col("src").alias("i"), F.col("dst").alias("j"), "rel")
    return _on_graphs(vectors.select("doc_id", "event_no", F.col("embedding").alias("x")), ends, work, made[0]["w"].shape[1], 4 * max(layer["w"].shape[2] for layer in made))


def relation_weights(attended: DataFrame) -> DataFrame:
    """`doc_id`, `rel`, `weight`: the mean weight of each relation over a document's events, to 6 places."""
    rows = attended.where("error IS NULL").select("doc_id", F.posexplode("weights").alias("rel", "w"))
    return rows.groupBy("doc_id", "rel").agg(F.round(F.avg("w"), 6).alias("weight"))
