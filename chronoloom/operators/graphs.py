"""Event graphs: closure, components, repair, structural features.

All graphs of a corpus are two tables, `nodes` (doc_id, event_no) and `edges` (doc_id, i, j). Closure, features and components
of many documents at once are array work on whole documents after one shuffle; documents too large for that go by joins. All
else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import batches as bt
from chronoloom.functions.storage import stored

#: The order of the features.
FEATURES = [
    "in_degree", "out_degree", "pred_two_hop", "succ_two_hop", "succ_sole_count", "pred_sole_count",
    "pred_three_hop", "succ_three_hop", "reach_local_proxy", "pred_inv_degree_sum", "succ_inv_degree_sum",
]


# closure and components


#: Events of a document up to which its closure is bits in one task, 64 MB of them, and pairs that one Arrow batch of it holds.
CLOSURE_EVENTS, PAIRS_TOGETHER = 23_000, 1 << 18


def _bit_rows(local: np.ndarray, width: int) -> np.ndarray:
    """For each node the bits of itself alone."""
    own = np.zeros((len(local), width), np.uint64)
    own[np.arange(len(local)), local >> 6] = np.uint64(1) << (local & 63).astype(np.uint64)
    return own


def _closed(local: np.ndarray, width: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each node the bits of all that it reaches and its own, of many graphs at once, from the last place of each to the first.

    Edges that lead backwards make it go over them until nothing changes.
    """
    closed = _bit_rows(local, width)
    order = np.lexsort((src, -local[src]))
    s, d = src[order], dst[order]
    head = bt.runs_of(s)
    who = s[head[:-1]]
    turn = bt.runs_of(local[who])
    backward = bool((local[dst] <= local[src]).any())
    while True:
        before = closed.copy() if backward else None
        for a, b in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True):
            first = head[a]
            closed[who[a:b]] |= np.bitwise_or.reduceat(closed[d[first : head[b]]], head[a:b] - first, axis=0)
        if not backward or (before == closed).all():
            return closed


def _by_width(g: bt.Graphs) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Graphs of like size together: words of a node's bits, the events, and the places among them of the edges' sources and targets."""
    wide = (np.maximum(1, g.sizes) + 63) // 64
    kind = np.repeat(np.ceil(np.log2(wide)).astype(np.int64), g.sizes)  # of up to 64, 128, 256, ... events
    for k in np.unique(kind):
        some, edge = np.flatnonzero(kind == k), np.flatnonzero(kind[g.src] == k)
        place = np.full(g.n, -1)
        place[some] = np.arange(len(some))
        yield 1 << int(k), some, place[g.src[edge]], place[g.dst[edge]]


def _by_edges(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges of documents that join at most `most` events, and of the larger ones, if there are any."""
    rows = stored(edges.select("doc_id", "i", "j"))
    ends = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most // 2)
    large = stored(rows.join(ends, "doc_id", "left_semi").select("doc_id", F.explode(F.array("i", "j")).alias("v")).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("doc_id"))
    if not large.head(1):
        return rows, None
    return rows.join(large, "doc_id", "left_anti"), rows.join(large, "doc_id", "left_semi")


def _pairs_by_bits(edges: DataFrame) -> DataFrame:
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g = bt.graphs_of(table)
        for width, some, src, dst in _by_width(g):
            local = g.local[some]
            reached = _closed(local, width, src, dst)
            reached[np.arange(len(some)), local >> 6] &= ~(np.uint64(1) << (local & 63).astype(np.uint64))
            base = some - local  # the first event of each one's document
            ends = np.cumsum(np.bitwise_count(reached).sum(axis=1, dtype=np.int64))
            at = 0
            while at < len(some):
                until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_TOGETHER, "right"))
                until = max(at + 1, min(until, at + GATHERED // (64 * width)))
                own, place = np.nonzero(np.unpackbits(reached[at:until].view(np.uint8), axis=1, bitorder="little"))
                own += at
                doc, i = g.ids(some[own])
                yield pa.RecordBatch.from_arrays([doc, i, pa.array(g.event[base[own] + place], pa.int64())], names=["doc_id", "i", "j"])
                at = until

    return bt.whole_documents(edges.select("doc_id", "i", "j"), work, "doc_id long, i long, j long")


def reachable_pairs(edges: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j`: all pairs with a path from i to another node j.

    Many documents at once are bit sets after one shuffle, and pairs leave in bounded batches. The bits of a document of n events take
    n * n / 8 bytes; those of more than `CLOSURE_EVENTS` go by joins, with the same results.
    """
    small, large = _by_edges(edges, CLOSURE_EVENTS)
    out = _pairs_by_bits(small)
    return out if large is None else out.unionByName(reachable_pairs_by_joins(large))


def implied_edges(edges: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j`: the edges beside which another path leads from i to j, by a first step to another node."""
    small, large = _by_edges(edges, CLOSURE_EVENTS)

    def work(table: pa.Table) -> pa.Table:
        g = bt.graphs_of(table)
        found = [np.zeros(0, np.int64)] * 2
        for width, some, src, dst in _by_width(g):
            pair = np.unique(src * np.int64(len(some)) + dst)  # by source
            s, d = pair // max(1, len(some)), pair % max(1, len(some))
            closed = _closed(g.local[some], width, s, d)
            head = bt.runs_of(s)
            degree = np.diff(head)
            word, bit = g.local[some][d] >> 6, (g.local[some][d] & 63).astype(np.uint64)
            implied = np.zeros(len(s), bool)
            for forth in (True, False):  # what the successors before an edge reach, then those after it
                seen = np.zeros((len(degree), width), np.uint64)
                for k in range(int(degree.max(initial=0))):
                    own = np.flatnonzero(degree > k)
                    e = head[own] + k if forth else head[own + 1] - 1 - k
                    implied[e] |= (seen[own, word[e]] >> bit[e] & np.uint64(1)).astype(bool)
                    seen[own] |= closed[d[e]]
            found.append(some[s[implied]])
            found.append(some[d[implied]])
        i, j = np.concatenate(found[::2]), np.concatenate(found[1::2])
        return pa.table([*g.ids(i), pa.array(g.event[j], pa.int64())], ["doc_id", "i", "j"])

    out = bt.whole_documents(small, work, "doc_id long, i long, j long")
    if large is None:
        return out
    one, pairs = stored(large.distinct()), stored(reachable_pairs_by_joins(large))
    other = one.select("doc_id", "i", F.col("j").alias("x")).join(pairs.select("doc_id", F.col("i").alias("x"), "j"), ["doc_id", "x"])
    return out.unionByName(one.join(other, ["doc_id", "i", "j"], "left_semi"))


def reachable_pairs_by_joins(edges: DataFrame) -> DataFrame:
    """The same by joins alone, for graphs too large for one task.

    Pairs keep their distance. When all up to a distance m are known, each pair m apart (and no other) is followed by what its end
    reaches within m: this gives all up to 2 m, so the rounds grow with the logarithm of the longest distance.
    """
    known = [stored(edges.select("doc_id", "i", "j", F.lit(1).cast("long").alias("d")).where("i != j").distinct())]
    m = 1
    while True:
        pairs = known[0]
        for more in known[1:]:
            pairs = pairs.unionByName(more)
        ends = pairs.where(F.col("d") == m).select("doc_id", "i", F.col("j").alias("w"))
        further = ends.join(pairs.select("doc_id", F.col("i").alias("w"), "j", "d"), ["doc_id", "w"]).where("i != j")
        new = stored(further.groupBy("doc_id", "i", "j").agg((F.min("d") + m).alias("d")).join(pairs, ["doc_id", "i", "j"], "left_anti"))
        if not new.head(1):
            return pairs.select("doc_id", "i", "j")
        known.append(new)
        m *= 2


def reachable_counts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`doc_id`, `n_pairs`: R(G) of every document."""
    counts = pairs.groupBy("doc_id").agg(F.count("*").alias("n_pairs"))
    return nodes.select("doc_id").distinct().join(counts, "doc_id", "left").na.fill(0, ["n_pairs"])


def path_exists(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """`queries` (doc_id, s, t) with `found`: whether t is reached from s; a node reaches itself."""
    hit = pairs.select("doc_id", F.col("i").alias("s"), F.col("j").alias("t"), F.lit(True).alias("hit"))
    return queries.join(hit, ["doc_id", "s", "t"], "left").select("doc_id", "s", "t", ((F.col("s") == F.col("t")) | F.coalesce("hit", F.lit(False))).alias("found"))


def lineage(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """`doc_id`, `anchor`, `event_no`, `side`: ancestors and descendants of the anchors (doc_id, anchor), the anchor in both."""
    down = pairs.select("doc_id", F.col("i").alias("anchor"), F.col("j").alias("event_no")).join(anchors, ["doc_id", "anchor"], "left_semi").withColumn("side", F.lit("descendant"))
    up = pairs.select("doc_id", F.col("j").alias("anchor"), F.col("i").alias("event_no")).join(anchors, ["doc_id", "anchor"], "left_semi").withColumn("side", F.lit("ancestor"))
    own = anchors.select("doc_id", "anchor", F.col("anchor").alias("event_no"), F.explode(F.array(F.lit("descendant"), F.lit("ancestor"))).alias("side"))
    return down.unionByName(up).unionByName(own)


#: Rows of a document up to which its components are found in one task, about 200 MB.
COMPONENT_ROWS = 4 << 20


def _component_roots(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each node the smallest of its component: roots are hooked under smaller ones along the edges, then all pointers jump to their roots."""
    root = np.arange(n)
    while len(src):
        a, b = root[src], root[dst]
        apart = a != b
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root[root] == root).all():
            root = root[root]
    return root


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`doc_id`, `event_no`, `component` (its smallest event), `all_connected` (whether the document has one component).

    Flat arrays hold many documents at once; documents above `COMPONENT_ROWS` rows go by joins.
    """
    rows = stored(bt.tagged(nodes.select("doc_id", "event_no"), edges.select("doc_id", "i", "j")))
    large = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > COMPONENT_ROWS).select("doc_id"))

    def work(table: pa.Table) -> pa.Table:
        g = bt.graphs_of(table)
        at = np.flatnonzero(g.rows >= 0)
        root = _component_roots(g.n, g.src, g.dst)[at]
        graph = g.graph[at]
        head = bt.runs_of(graph)
        one = np.minimum.reduceat(root, head[:-1]) == np.maximum.reduceat(root, head[:-1]) if len(at) else np.zeros(0, bool)
        return pa.table([*g.ids(at), pa.array(g.event[root], pa.int64()), pa.array(np.repeat(one, np.diff(head)) if len(at) else one)], ["doc_id", "event_no", "component", "all_connected"])

    schema = "doc_id long, event_no long, component long, all_connected boolean"
    if not large.head(1):
        return bt.whole_documents(rows, work, schema)
    own = rows.join(large, "doc_id", "left_semi")
    out = bt.whole_documents(rows.join(large, "doc_id", "left_anti"), work, schema)
    return out.unionByName(components_by_joins(own.where("j IS NULL").select("doc_id", F.col("i").alias("event_no")), own.where("j IS NOT NULL")))


def components_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by joins: each event takes the smallest label among its neighbours, then the label that its label has."""
    both = stored(edges.select("doc_id", "i", "j").union(edges.select("doc_id", "j", "i")).distinct())
    key = ["doc_id", "event_no"]
    ends = both.select("doc_id", F.col("i").alias("event_no"))
    labels = stored(nodes.select(*key).union(ends).distinct().withColumn("component", F.col("event_no")))
    while True:
        near = both.join(labels.select("doc_id", F.col("event_no").alias("j"), "component"), ["doc_id", "j"]).groupBy("doc_id", F.col("i").alias("event_no")).agg(F.min("component").alias("near"))
        new = labels.join(near, key, "left").select(*key, "component", F.least("component", "near").alias("least"))
        new = stored(new)
        jumped = new.join(new.select("doc_id", F.col("event_no").alias("least"), F.col("least").alias("further")), ["doc_id", "least"]).select(*key, F.least("least", "further").alias("component"), (F.col("component") != F.least("least", "further")).alias("moved"))
        jumped = stored(jumped)
        labels = jumped.select(*key, "component")
        if not jumped.where("moved").head(1):
            break
    rows = nodes.select(*key).join(labels, key)
    whole = Window.partitionBy("doc_id")
    return rows.withColumn("all_connected", F.min("component").over(whole) == F.max("component").over(whole))


# temporal repair


def transitive_reduction(causal: DataFrame, temporal: DataFrame) -> DataFrame:
    """Temporal edges that no other path through causal and temporal edges implies. Edges run from small to large, so the order
    of removal doesn't matter: (u, v) goes if there are an edge u to w and a path w to v."""
    edges = causal.select("doc_id", "i", "j").union(temporal.select("doc_id", "i", "j"))
    return temporal.join(implied_edges(edges), ["doc_id", "i", "j"], "left_anti")


def connect_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges of events without any: from the event before, for the first one to the second; none in single-event documents."""
    ends = edges.select("doc_id", F.explode(F.array("i", "j")).alias("event_no")).distinct().withColumn("linked", F.lit(True))
    rows = nodes.select("doc_id", "event_no").join(ends, ["doc_id", "event_no"], "left")
    order = Window.partitionBy("doc_id").orderBy("event_no")
    rows = rows.select("doc_id", "event_no", F.col("linked").isNull().alias("alone"), F.lag("event_no").over(order).alias("before"), F.lead("event_no").over(order).alias("after"), F.lag(F.col("linked").isNull()).over(order).alias("before_alone"), F.lag("event_no", 2).over(order).alias("before2"))
    first = F.col("before").isNull()
    second_of_two = F.col("before2").isNull() & F.col("before_alone")  # the first event's edge reaches it
    rows = rows.where(F.col("alone") & (F.col("before").isNotNull() | F.col("after").isNotNull()) & ~F.coalesce(~first & second_of_two, F.lit(False)))
    return rows.select("doc_id", F.when(first, F.col("event_no")).otherwise(F.col("before")).alias("i"), F.when(first, F.col("after")).otherwise(F.col("event_no")).alias("j"))


def bridge_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges from the document's smallest event to the smallest event of each other component."""
    found = connected_components(nodes, edges)
    first = F.min("event_no").over(Window.partitionBy("doc_id"))
    heads = found.withColumn("i", first).where((F.col("component") == F.col("event_no")) & (F.col("event_no") != F.col("i")))
    return heads.select("doc_id", "i", F.col("event_no").alias("j"))


#: Events of a block of vectors, leading components that a block's bound is made of, and blocks of pairs that are worked on together.
VECTOR_BLOCK, LEADING = 512, 16
#: Slack of the bound, above what sums of products are off by.
SLACK = 1e-9


def _products(a: np.ndarray, b: np.ndarray, least: float | None) -> np.ndarray | None:
    """Products of the rows of two blocks of unit vectors; none if no pair can come to `least`: the products of the leading components and
    those of the norms of the rest bound them."""
    if least is not None and a.shape[1] > LEADING:
        rest = np.outer(*(np.sqrt(np.maximum(0, (x[:, LEADING:] ** 2).sum(axis=1))) for x in (a, b)))
        if (a[:, :LEADING] @ b[:, :LEADING].T + rest).max(initial=-np.inf) < least - SLACK:
            return None
    return a @ b.T


def pair_similarity(vectors: DataFrame, least: float | None = None) -> DataFrame:
    """`doc_id`, `i`, `j`, `sim`: cosines of all forward pairs of a document's events, of unit vectors; a zero vector's are 0. With `least`
    the pairs from that similarity on.

    Work goes by (document, block, block) of event numbers, so a large document spreads over tasks: each block of its vectors goes to all pairs
    of blocks that it is in. With `least` other pairs are never rows, and blocks whose bound is below it aren't multiplied out.
    """
    block = F.expr(f"event_no div {VECTOR_BLOCK}")
    rows = vectors.select("doc_id", "event_no", "embedding", block.alias("own"))
    several = rows.groupBy("doc_id").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("doc_id")
    blocks = stored(rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("own").alias("blocks")))
    if blocks.head(1):
        rows = rows.join(blocks, "doc_id", "left")
        rows = rows.withColumn("other", F.explode(F.coalesce("blocks", F.array("own"))))
    else:
        rows = rows.withColumn("other", F.col("own"))
    rows = rows.select("doc_id", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "event_no", "embedding")
    schema = pa.schema([("doc_id", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64())])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        vector = table.column("embedding").combine_chunks()
        size = vector.value_lengths().to_numpy()
        x = vector.flatten().to_numpy(zero_copy_only=False).astype(float)
        event, own, doc = (table.column(c).combine_chunks() for c in ("event_no", "own", "doc_id"))
        event, own = event.to_numpy(), own.to_numpy()
        group = bt.runs_of(bt.keys(table, ["doc_id", "a", "b"]))
        at = np.concatenate([[0], np.cumsum(size)])
        parts, total = [], 0
        for lo, hi in zip(group[:-1].tolist(), group[1:].tolist(), strict=True):
            unit = x[at[lo] : at[hi]].reshape(hi - lo, -1)
            norm = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            unit = unit / np.where(norm > 0, norm, 1)
            cut = int((own[lo:hi] == own[lo]).sum())  # rows of both blocks, if there are two
            first, second = (slice(0, cut), slice(cut, hi - lo)) if cut < hi - lo else (slice(0, cut),) * 2
            found = _products(unit[first], unit[second], least)
            if found is None:
                continue
            i, j = np.nonzero((event[lo:hi][first][:, None] < event[lo:hi][second][None, :]) & (True if least is None else found >= least))
            parts.append((np.full(len(i), lo), event[lo:hi][first][i], event[lo:hi][second][j], found[i, j]))
            total += len(i)
            if total >= PAIRS_TOGETHER:
                yield _batch(parts, doc, schema)
                parts, total = [], 0
        if parts:
            yield _batch(parts, doc, schema)

    return bt.whole_documents(rows, work, "doc_id long, i long, j long, sim double", ("own", "event_no"), ("doc_id", "a", "b"), together=1 << 13)


def _batch(parts: list[tuple], doc: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    row, i, j, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([doc.take(pa.array(row, pa.int64())), pa.array(i), pa.array(j), pa.array(sim)], schema=schema)


def similar_pairs(vectors: DataFrame, min_sim: float = 0.70) -> DataFrame:
    """The candidates (`similarity_candidates`) from vectors, without making other pairs."""
    return similarity_candidates(pair_similarity(vectors, min_sim), min_sim)


def similarity_candidates(pairs: DataFrame, min_sim: float = 0.70) -> DataFrame:
    """Pairs of at least `min_sim`, with `sim` to 6 places and `rank` by similarity, then span, then place."""
    rows = pairs.where(F.col("sim") >= min_sim).withColumn("sim", F.round("sim", 6))
    order = Window.partitionBy("doc_id").orderBy(F.desc("sim"), F.col("j") - F.col("i"), "i")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


class _Paths:
    """Which events of one document reach which, as bits of places, kept up as edges are added: an edge gives what its end reaches to
    those before it that don't reach its end yet, and the other way round, so each pair is handed on once."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.after: list[int] = []
        self.before: list[int] = []

    def at(self, v: int) -> int:
        if v not in self.place:
            self.place[v] = len(self.after)
            self.after.append(0)
            self.before.append(0)
        return self.place[v]

    def joined(self, a: int, b: int) -> bool:
        return bool(self.after[a] >> b & 1 or self.after[b] >> a & 1)

    def add(self, a: int, b: int) -> None:
        sources, targets = self.before[a] | 1 << a, self.after[b] | 1 << b
        for some, other, ends, new in ((sources & ~self.before[b], self.after, 1 << b, targets), (targets & ~self.after[a], self.before, 1 << a, sources)):
            while some:
                low = some & -some
                other[low.bit_length() - 1] |= new
                some ^= low


def add_temporal_edges(causal: DataFrame, llm: DataFrame, candidates: DataFrame, sims: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j`, `source` (llm, similarity), `score`, `reason`: proposed edges that join what no path joins yet.

    `llm` may have a `reason`, which stays; a similarity's reason states it. Each insertion depends on those before, so a document is one
    unit of work; its proposals stream through a task in their order, which holds the document's bits alone.
    """
    zero, no_reason = F.lit(0).cast("double"), F.lit(None).cast("string")
    rows = causal.select("doc_id", "i", "j", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("priority"), zero.alias("sim"), no_reason.alias("reason"))
    known = sims.select("doc_id", "i", "j", "sim")
    said = F.col("reason") if "reason" in llm.columns else no_reason
    llm = llm.select("doc_id", "i", "j", "priority", said.alias("reason")).join(known, ["doc_id", "i", "j"], "left").select("doc_id", "i", "j", F.lit(1).alias("kind"), "priority", F.coalesce("sim", zero).alias("sim"), "reason")
    rows = rows.unionByName(llm).unionByName(candidates.select("doc_id", "i", "j", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("priority"), "sim", no_reason.alias("reason")))

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, paths = object(), _Paths()
        for batch in batches:
            docs, i, j, kind = (batch.column(k).to_pylist() for k in range(4))
            kept = []
            for k in range(batch.num_rows):
                if docs[k] != doc:
                    doc, paths = docs[k], _Paths()
                a, b = paths.at(i[k]), paths.at(j[k])
                if kind[k] == 0 or not paths.joined(a, b):
                    paths.add(a, b)
                    if kind[k]:
                        kept.append(k)
            yield batch.take(pa.array(kept, pa.int64())).select(["doc_id", "i", "j", "kind", "sim", "reason"])

    order = ["kind", "priority", F.desc("sim"), F.col("j") - F.col("i"), "i", "j"]
    rows = rows.select("doc_id", "i", "j", "kind", "priority", "sim", "reason").repartition("doc_id").sortWithinPartitions("doc_id", *order)
    out = rows.mapInArrow(insert, "doc_id long, i long, j long, kind int, sim double, reason string")
    similar = F.format_string("similarity %.3f, E%d before E%d", "sim", "i", "j")
    reason = F.when(F.col("kind") == 1, F.coalesce("reason", F.lit("named by an expert"))).otherwise(similar)
    return out.select("doc_id", "i", "j", F.when(F.col("kind") == 1, "llm").otherwise("similarity").alias("source"), F.round("sim", 4).alias("score"), reason.alias("reason"))


def complete_temporal(nodes: DataFrame, causal: DataFrame, llm: DataFrame, candidates: DataFrame, sims: DataFrame) -> DataFrame:
    """`doc_id`, `i`, `j`, `source` (llm, similarity, isolated, bridge), `reason`, `score`, `span`: all temporal edges after insertion,
    reduction, isolated events and bridges; those of the last two have score 0."""
    added = stored(add_temporal_edges(causal, llm, candidates, sims))
    kept = transitive_reduction(causal, added)
    base = causal.select("doc_id", "i", "j").union(kept.select("doc_id", "i", "j")).distinct()
    none = F.lit(0).cast("double").alias("score")
    alone = stored(connect_isolated(nodes, base))
    more = base.union(alone.select("doc_id", "i", "j")).distinct()
    alone = alone.select("doc_id", "i", "j", F.lit("isolated").alias("source"), none, F.format_string("an event without edges: E%d before E%d", "i", "j").alias("reason"))
    bridges = bridge_components(nodes, more).select("doc_id", "i", "j", F.lit("bridge").alias("source"), none, F.format_string("two components: E%d before E%d", "i", "j").alias("reason"))
    rows = kept.unionByName(alone).unionByName(bridges)
    return rows.select("doc_id", "i", "j", "source", "reason", "score", (F.col("j") - F.col("i")).alias("span"))


# features


def graph_sizes(nodes: DataFrame, causal: DataFrame, temporal: DataFrame) -> DataFrame:
    """`doc_id`, `n_nodes`, `n_edges` (distinct), `n_causal`, `n_temporal`: one aggregate over all rows of a document."""
    flag = lambda df, c, t: df.select("doc_id", "i", "j", F.lit(c).alias("c"), F.lit(t).alias("t"))
    edges = flag(causal, 1, 0).unionByName(flag(temporal, 0, 1)).groupBy("doc_id", "i", "j").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    edges = edges.groupBy("doc_id").agg(F.count("*").alias("n_edges"), F.sum("c").alias("n_causal"), F.sum("t").alias("n_temporal"))
    out = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes")).join(edges, "doc_id", "left")
    return out.na.fill(0, ["n_edges", "n_causal", "n_temporal"])


def _counted(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy("doc_id", F.col(key).alias("event_no")).agg(F.count("*").alias(name))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`doc_id`, `event_no`, `in_degree`, `out_degree`, `degree`."""
    ends = edges.select("doc_id", F.inline(F.array(F.struct(F.col("i").alias("event_no"), F.lit(0).alias("into"), F.lit(1).alias("out")), F.struct(F.col("j").alias("event_no"), F.lit(1).alias("into"), F.lit(0).alias("out")))))
    ends = ends.groupBy("doc_id", "event_no").agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))
    rows = nodes.select("doc_id", "event_no").join(ends, ["doc_id", "event_no"], "left").na.fill(0, ["in_degree", "out_degree"])
    return rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def _hops(edges: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """New nodes two and three steps along the edges: (doc_id, i, j) of each kind. Repeats go before each further step; with `keep`
    the second steps are stored, as they are read three times."""
    one = edges.select("doc_id", "i", "j")
    step = lambda rows: rows.select("doc_id", "i", F.col("j").alias("w")).join(one.select("doc_id", F.col("i").alias("w"), "j"), ["doc_id", "w"]).select("doc_id", "i", "j").where("i != j").distinct()
    two = step(one).join(one, ["doc_id", "i", "j"], "left_anti")
    two = stored(two) if keep else two
    three = step(two).join(one, ["doc_id", "i", "j"], "left_anti").join(two, ["doc_id", "i", "j"], "left_anti")
    return two, three


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", F.col("j").alias("i"), F.col("i").alias("j"))


def _with(nodes: DataFrame, *parts: DataFrame) -> DataFrame:
    out = nodes.select("doc_id", "event_no")
    for p in parts:
        out = out.join(p, ["doc_id", "event_no"], "left")
    return out.na.fill(0)


def hop_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`pred_two_hop`, `succ_two_hop`, `pred_three_hop`, `succ_three_hop`: each hop is made once from stored edges."""
    edges = stored(edges.select("doc_id", "i", "j"))
    parts = []
    for side, own in (("pred", _turned(edges)), ("succ", edges)):
        two, three = _hops(own, keep=True)
        parts += [_counted(two, "i", f"{side}_two_hop"), _counted(three, "i", f"{side}_three_hop")]
    return _with(nodes, *parts)


def two_hop_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`pred_two_hop`, `succ_two_hop`: nodes at two steps that are neither neighbours nor the node itself."""
    return raw_features(nodes, edges, ["pred_two_hop", "succ_two_hop"])


def three_hop_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`pred_three_hop`, `succ_three_hop`: further nodes that the new two-step ones lead to."""
    return raw_features(nodes, edges, ["pred_three_hop", "succ_three_hop"])


def reach_local_proxy(two_hops: DataFrame) -> DataFrame:
    """`reach_local_proxy`: the product of both two-step counts."""
    return two_hops.select("doc_id", "event_no", (F.col("pred_two_hop") * F.col("succ_two_hop")).alias("reach_local_proxy"))


def sole_counts(nodes: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """`succ_sole_count`: successors without another predecessor; `pred_sole_count`: predecessors without another successor."""
    at = lambda end, d: edges.join(degree.select("doc_id", F.col("event_no").alias(end), d), ["doc_id", end])
    succ = at("j", "in_degree").where("in_degree = 1")
    pred = at("i", "out_degree").where("out_degree = 1")
    return _with(nodes, _counted(succ, "i", "succ_sole_count"), _counted(pred, "j", "pred_sole_count"))


def inv_degree_sums(nodes: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """`pred_inv_degree_sum`, `succ_inv_degree_sum`: sums of 1 / degree over predecessors and over successors."""
    inv = (1 / F.greatest(F.lit(1), F.col("degree"))).cast("double")
    at = lambda end, to, name: edges.join(degree.select("doc_id", F.col("event_no").alias(end), "degree"), ["doc_id", end]).groupBy("doc_id", F.col(to).alias("event_no")).agg(F.sum(inv).alias(name))
    return _with(nodes, at("i", "j", "pred_inv_degree_sum"), at("j", "i", "succ_inv_degree_sum"))


def minmax_by_doc(df: DataFrame, columns: list[str], by: str = "doc_id") -> DataFrame:
    """The columns scaled to [0, 1] in each document; NaN and infinities count as 0, a constant column becomes 0."""
    whole = Window.partitionBy(by)
    clean = {c: F.when(F.isnan(F.col(c).cast("double")) | F.col(c).cast("double").isin(float("inf"), float("-inf")) | F.col(c).isNull(), 0.0).otherwise(F.col(c).cast("double")) for c in columns}
    df = df.withColumns(clean)
    out = {}
    for c in columns:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
        out[c] = F.when(flat, 0.0).otherwise((F.col(c) - low) / (high - low))
    return df.withColumns(out)


#: Events, and events and edges together, of a document up to which its sets are bits in one task: 32 MB of them for each kind.
BIT_EVENTS, BIT_ROWS = 1 << 14, 1 << 19
#: Bytes of bits that are gathered at once.
GATHERED = 16 << 20


def _either(bits: np.ndarray, to: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the bits of any of the rows `to` between its bounds, gathered in blocks of bounded size."""
    out = np.zeros_like(bits)
    row_bytes = 8 * bits.shape[1]
    at, n = 0, len(bits)
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GATHERED // row_bytes, "right")) - 1)
        some = at + np.flatnonzero(np.diff(bounds[at : end + 1]))
        if len(some):
            out[some] = np.bitwise_or.reduceat(bits[to[bounds[at] : bounds[end]]], bounds[some] - bounds[at], axis=0)
        at = end
    return out


def _new_steps(local: np.ndarray, width: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New nodes two and three steps along the edges, counted for each node, of graphs of up to 64 * `width` nodes.

    A set is `width` words of bits by the places in the document. The nodes three steps away are those two steps from a successor: what these
    sets hold beside the new ones is nearer.
    """
    n = len(local)
    order, bounds = bt.grouped(src, n)
    to = dst[order]
    own = _bit_rows(local, width)
    one = _either(own, to, bounds)
    step = _either(one, to, bounds)
    near = one | own
    two = np.bitwise_count(step & ~near).sum(axis=1, dtype=np.int64)
    near |= step
    return two, np.bitwise_count(_either(step, to, bounds) & ~near).sum(axis=1, dtype=np.int64)


def _hops_of(g: bt.Graphs) -> dict[str, np.ndarray]:
    """Counts of new nodes two and three steps away, both ways, documents of like size together."""
    out = {f"{side}_{steps}_hop": np.zeros(g.n, np.int64) for side in ("pred", "succ") for steps in ("two", "three")}
    for width, some, src, dst in _by_width(g):
        for side, a, b in (("succ", src, dst), ("pred", dst, src)):
            out[f"{side}_two_hop"][some], out[f"{side}_three_hop"][some] = _new_steps(g.local[some], width, a, b)
    return out


def features_of(g: bt.Graphs) -> dict[str, np.ndarray]:
    """The eleven features and `degree` of all events of some graphs; an end that is no node of its document has no degree to look at."""
    into, out = np.bincount(g.dst, minlength=g.n), np.bincount(g.src, minlength=g.n)
    hops = _hops_of(g)
    known = g.rows >= 0
    inverse = known / np.maximum(1, into + out)
    return hops | {
        "in_degree": into, "out_degree": out, "degree": into + out, "reach_local_proxy": hops["pred_two_hop"] * hops["succ_two_hop"],
        "succ_sole_count": np.bincount(g.src[(into == 1)[g.dst] & known[g.dst]], minlength=g.n), "pred_sole_count": np.bincount(g.dst[(out == 1)[g.src] & known[g.src]], minlength=g.n),
        "pred_inv_degree_sum": bt.segment_sum(inverse[g.src], g.dst, g.n), "succ_inv_degree_sum": bt.segment_sum(inverse[g.dst], g.src, g.n),
    }


def _scaled(values: np.ndarray, g: bt.Graphs, rows: np.ndarray) -> np.ndarray:
    """Scaled to [0, 1] over the events `rows` of each document, which are in order; a constant column becomes 0."""
    graph = g.graph[rows]
    head = bt.runs_of(graph)[:-1]
    low, high = (np.repeat(f.reduceat(values, head), np.diff(head, append=len(rows))) for f in (np.minimum, np.maximum))
    flat = np.abs(high - low) <= 1e-9 * np.maximum(np.abs(high), np.abs(low))
    return np.where(flat, 0.0, (values - low) / np.where(flat, 1.0, high - low))


def _whole(c: str) -> bool:
    return not c.endswith("_sum")


def _features_by_bits(rows: DataFrame, columns: list[str], scaled: bool) -> DataFrame:
    """`columns` of the events of `tagged` documents, in one pass over each."""

    def work(table: pa.Table) -> pa.Table:
        g = bt.graphs_of(table)
        at = np.flatnonzero(g.rows >= 0)
        found = features_of(g)
        out = dict(zip(("doc_id", "event_no"), g.ids(at), strict=True))
        for c in columns:
            own = found[c][at]
            out[c] = pa.array(_scaled(own.astype(float), g, at)) if scaled and len(at) else pa.array(own, pa.int64() if _whole(c) and not scaled else pa.float64())
        return pa.table(out)

    kinds = ", ".join(f"{c} {'long' if _whole(c) and not scaled else 'double'}" for c in columns)
    return bt.whole_documents(rows, work, f"doc_id long, event_no long, {kinds}")


def by_size(nodes: DataFrame, edges: DataFrame, *more: str) -> tuple[DataFrame, DataFrame | None]:
    """The `tagged` rows of documents that one task holds as bits, and of the larger ones, if there are any. Their tables are written once."""
    rows = stored(bt.tagged(nodes, edges, *more))
    size = rows.groupBy("doc_id").agg(F.count_if(F.col("j").isNull()).alias("events"), F.count("*").alias("rows"))
    large = stored(size.where((F.col("events") > BIT_EVENTS) | (F.col("rows") > BIT_ROWS)).select("doc_id"))
    if not large.head(1):
        return rows, None
    return rows.join(large, "doc_id", "left_anti"), rows.join(large, "doc_id", "left_semi")


def _features(nodes: DataFrame, edges: DataFrame, columns: list[str], scaled: bool) -> DataFrame:
    small, large = by_size(nodes, edges)
    out = _features_by_bits(small, columns, scaled)
    if large is None:
        return out
    found = features_by_joins(large.where("j IS NULL").select("doc_id", F.col("i").alias("event_no")), large.where("j IS NOT NULL"))
    found = minmax_by_doc(found, columns) if scaled else found
    return out.unionByName(found.select("doc_id", "event_no", *columns))


def features_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The eleven features and `degree` by joins alone, for documents too large for one task."""
    nodes, edges = stored(nodes.select("doc_id", "event_no")), stored(edges.select("doc_id", "i", "j"))
    degree = stored(degrees(nodes, edges))
    key = ["doc_id", "event_no"]
    rows = degree.join(hop_counts(nodes, edges), key).join(sole_counts(nodes, edges, degree), key).join(inv_degree_sums(nodes, edges, degree), key)
    return rows.withColumn("reach_local_proxy", F.col("pred_two_hop") * F.col("succ_two_hop"))


def raw_features(nodes: DataFrame, edges: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """The features before scaling, and `degree` if it is among `columns`; an event comes once."""
    return _features(nodes, edges, columns, False)


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The eleven features of each event, scaled in its document.

    Events and edges meet in one shuffle; neighbourhoods are bit sets, of many documents at once. Documents above `BIT_EVENTS` events
    or `BIT_ROWS` rows go by joins, with the same results.
    """
    return _features(nodes, edges, FEATURES, True)

