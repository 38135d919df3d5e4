"""Dismantling ground truth: minimal removal sets of a document's graph, and tiered importance labels from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import batches as bt
from chronoloom.functions.storage import stored

from .graphs import by_size, features_by_joins, features_of

#: Share of pairs that may remain, sizes of graphs that get labels, tolerance of ties and members, tiers.
THETA = 0.5
MIN_NODES, MAX_NODES = 3, 30
PLACES = 9
MEMBER_ABOVE = 1e-9
LOW_TIER, HIGH_TIER = 0.3, 0.7
#: Sets that are tried at once, and branches of the search in one task.
CHUNK, TASK_BRANCHES = 4096, 256
#: Words of the bit sets that greedy removal holds at once, 32 MB, or those of one graph.
BLOCK_WORDS = 4_000_000


def remaining_pairs(succ: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """Reachable pairs that are left of a graph (bit masks of successors) for each mask of removed nodes."""
    n = len(succ)
    keep = ~removed.astype(np.uint64)
    reach = np.zeros((n, len(removed)), np.uint64)
    forward = all(int(s) >> v << v == int(s) for v, s in enumerate(succ))
    while True:
        before = None if forward else reach.copy()
        for v in range(n - 1, -1, -1):
            bits = np.zeros(len(removed), np.uint64)
            for w in range(n):
                if int(succ[v]) >> w & 1:
                    alive = keep >> np.uint64(w) & np.uint64(1)
                    bits |= (reach[w] | np.uint64(1 << w)) * alive
            reach[v] = bits
        if forward or (before == reach).all():
            break
    total = np.zeros(len(removed), np.int64)
    for v in range(n):
        alive = (keep >> np.uint64(v) & np.uint64(1)).astype(np.int64)
        total += np.bitwise_count(reach[v] & ~np.uint64(1 << v)).astype(np.int64) * alive
    return total


def adjacency(nodes: DataFrame, edges: DataFrame, min_nodes: int = 1, max_nodes: int | None = None) -> DataFrame:
    """`doc_id`, `ids` (events in order), `pairs` (places of edges) of documents in the size band, which may have no upper end."""
    ids = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list("event_no")).alias("ids")).where(F.size("ids") >= min_nodes)
    if max_nodes is not None:
        ids = ids.where(F.size("ids") <= max_nodes)
    sized = edges.join(ids.select("doc_id"), "doc_id", "left_semi")
    pairs = sized.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("i", "j"))).alias("pairs"))
    return ids.join(pairs, "doc_id", "left")


def _masks(ids: list[int], pairs: list | None) -> np.ndarray:
    place = {int(v): k for k, v in enumerate(ids)}
    succ = [0] * len(ids)
    for p in pairs if pairs is not None else []:
        if p["i"] in place and p["j"] in place and p["i"] != p["j"]:
            succ[place[p["i"]]] |= 1 << place[p["j"]]
    return np.array(succ, np.uint64)


def _reach(succ: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """For each event and mask of removed ones, the events that it still reaches, itself too; none for a removed one."""
    n = len(succ)
    keep = ~removed.astype(np.uint64)
    reach = np.zeros((n, len(removed)), np.uint64)
    to = [[w for w in range(n) if int(s) >> w & 1] for s in succ]
    forward = all(w > v for v, some in enumerate(to) for w in some)
    while True:
        before = None if forward else reach.copy()
        for v in range(n - 1, -1, -1):
            bits = np.full(len(removed), 1 << v, np.uint64)
            for w in to[v]:
                bits |= reach[w]
            reach[v] = np.where(keep >> np.uint64(v) & np.uint64(1), bits, np.uint64(0))
        if forward or (before == reach).all():
            return reach


def branch(succ: np.ndarray, k: int, first: int, target: int) -> tuple[list[tuple[int, int]], int]:
    """All sets of k events, the dearest of them the one at place `first`, whose removal leaves at most `target` reachable pairs, as masks with
    what they leave; and how many sets, smaller ones too, were tried.

    The pairs that an event's removal costs are at most those from what reaches it to what it reaches, which only get fewer as others
    go. Events are placed from the dearest to the cheapest, and a set grows by later ones; where even the dearest of these
    together leave too many pairs the branch ends.
    """
    n = len(succ)
    pred = np.array([sum(1 << u for u in range(n) if int(succ[u]) >> v & 1) for v in range(n)], np.uint64)
    mirrored = lambda masks: np.array([int(f"{int(m):0{n}b}"[::-1], 2) for m in masks], np.uint64)
    back = mirrored(pred[::-1])  # edges turned round, events in the order from last to first, so they lead forwards again
    found: list[tuple[int, int]] = []
    tried = 0

    def spread(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many each event reaches, and is reached from, itself too."""
        return np.bitwise_count(_reach(succ, masks)).astype(np.int64), np.bitwise_count(_reach(back, mirrored(masks))).astype(np.int64)[::-1]

    after, before = spread(np.zeros(1, np.uint64))
    order = np.argsort(-(before * after)[:, 0], kind="stable")

    def grow(masks: np.ndarray, last: np.ndarray, size: int) -> None:
        nonlocal tried
        tried += len(masks)
        if size == k:
            left = np.maximum(0, np.bitwise_count(_reach(succ, masks)).astype(np.int64) - 1).sum(axis=0)
            found.extend((int(masks[x]), int(left[x])) for x in np.flatnonzero(left <= target))
            return
        after, before = spread(masks)
        left = np.maximum(0, after - 1).sum(axis=0)
        cost = np.maximum(0, before * after - 1)[order]
        cost[np.arange(n)[:, None] <= last] = -1  # not to be added
        more = k - size
        # the event itself, and the dearest of those behind it
        best = np.zeros((n + 1, len(masks)), np.int64)
        if more > 1:
            for v in range(n - 1, -1, -1):
                dearest = np.sort(np.maximum(cost[v:], 0), axis=0)[-(more - 1) :].sum(axis=0)
                best[v] = dearest
        enough = (cost >= 0) & (left - cost - best[1:] <= target) & (np.arange(n)[:, None] <= n - more)
        who, event = np.nonzero(enough.T)
        for lo in range(0, len(who), CHUNK):
            some, v = who[lo : lo + CHUNK], event[lo : lo + CHUNK]
            grow(masks[some] | (np.uint64(1) << order[v].astype(np.uint64)), v, size + 1)

    grow(np.array([1 << int(order[first])], np.uint64), np.array([first]), 1)
    return found, tried


def minimal_removal_sets(nodes: DataFrame, edges: DataFrame, theta: float = THETA, min_nodes: int = MIN_NODES, max_nodes: int = MAX_NODES) -> DataFrame:
    """`doc_id`, `set_no`, `members`, `k`, `original_pairs`, `final_pairs`, `tried`: all smallest sets of events whose removal leaves at most
    ceil(theta * R) reachable pairs, in combination order; `final_pairs` is the least that any of them leaves, `tried` how many sets the search
    looked at.

    Graphs that are alike but for their events' numbers have one shape, the bits of each place's successors, and each shape is solved once; its
    sets, by places, go to all of its documents. Places are in the order of the events, so sets keep their order. Sizes go level by
    level. A level's work is a branch for each shape and dearest member, so a large graph spreads over tasks; branches end by a bound
    (`branch`). Solved shapes leave the loop, whose length is the largest k.
    """
    if max_nodes > 63:
        raise ValueError("a set is the bits of a word: 63 events at most")

    def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": pdf["ids"], "shape": [_masks(a, b).astype(np.int64) for a, b in zip(pdf["ids"], pdf["pairs"], strict=True)]})

    graphs = stored(adjacency(nodes, edges, min_nodes, max_nodes).mapInPandas(masked, "doc_id long, ids array<long>, shape array<long>"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"shape": pdf["shape"], "r": [int(remaining_pairs(np.array(s, np.uint64), np.zeros(1, np.uint64))[0]) for s in pdf["shape"]]})

    shapes = stored(graphs.select("shape").distinct().mapInPandas(whole, "shape array<long>, r long")).withColumn("target", F.ceil(F.lit(theta) * F.col("r")))
    none = shapes.where("r = 0").select("shape", F.array().cast("array<int>").alias("places"), F.lit(0).cast("long").alias("k"), F.col("r").alias("original_pairs"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("tried"))
    found = [none]
    open_ = shapes.where("r > 0")
    schema = "shape array<long>, places array<int>, k long, original_pairs long, left long, tried long"
    k = 0
    while k < max_nodes:
        k += 1
        branches = open_.where(F.size("shape") >= k).agg(F.sum(F.size("shape") - k + 1)).first()[0]
        if not branches:
            break
        work = open_.where(F.size("shape") >= k).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("shape") - k)))
        work = work.repartition(-(-branches // TASK_BRANCHES), "shape", "first")  # few bytes, long work: by number, so tasks aren't merged

        def attempt(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    sets, tried = branch(np.array(row.shape, np.uint64), k, int(row.first), int(row.target))
                    out.append((row.shape, None, k, row.r, None, tried))
                    out += [(row.shape, [p for p in range(len(row.shape)) if mask >> p & 1], k, row.r, left, 0) for mask, left in sets]
                yield pd.DataFrame(out, columns=["shape", "places", "k", "original_pairs", "left", "tried"]).astype({"left": "Int64"})

        done = stored(work.mapInPandas(attempt, schema))
        found.append(done)
        open_ = stored(open_.join(done.where("places IS NOT NULL").select("shape").distinct(), "shape", "left_anti"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    tried = rows.groupBy("shape").agg(F.sum("tried").alias("tried"))
    rows = rows.where("places IS NOT NULL").drop("tried")
    best = F.min("left").over(Window.partitionBy("shape"))
    number = F.row_number().over(Window.partitionBy("shape").orderBy("places")) - 1
    rows = rows.select("shape", number.cast("long").alias("set_no"), "places", "k", "original_pairs", best.alias("final_pairs"))
    rows = graphs.join(rows.join(tried, "shape"), "shape")
    return rows.select("doc_id", "set_no", F.transform("places", lambda p: F.get("ids", p)).alias("members"), "k", "original_pairs", "final_pairs", "tried")


def _left(succ: list[list[int]], alive: np.ndarray) -> np.ndarray:
    """Reachable pairs that are left of a graph of any size (lists of successors) for each column of `alive`, which events stay.

    `closed` has for each event the bits of all that it reaches and its own, in as many words as the graph needs.
    """
    n, words = len(succ), (len(succ) + 63) // 64
    total = np.zeros(alive.shape[1], np.int64)
    forward = all(w > v for v, to in enumerate(succ) for w in to)
    columns = max(1, BLOCK_WORDS // (n * words))
    for lo in range(0, alive.shape[1], columns):
        some = alive[:, lo : lo + columns]
        closed = np.zeros((n, words, some.shape[1]), np.uint64)
        changed = True
        while changed:
            changed = False
            for v in range(n - 1, -1, -1):
                bits = np.bitwise_or.reduce(closed[succ[v]], axis=0) if succ[v] else np.zeros_like(closed[v])
                bits[v >> 6] |= np.uint64(1 << (v & 63))
                bits *= some[v]
                if not forward:
                    changed = changed or not np.array_equal(bits, closed[v])
                closed[v] = bits
        for v in range(n):
            total[lo : lo + columns] += np.bitwise_count(closed[v]).sum(axis=0, dtype=np.int64)
        total[lo : lo + columns] -= some.sum(axis=0)
    return total


def _greedy(pdf: pd.DataFrame, theta: float) -> list[tuple]:
    out = []
    for row in pdf.itertuples(index=False):
        place = {int(v): k for k, v in enumerate(row.ids)}
        succ: list[list[int]] = [[] for _ in place]
        for p in row.pairs if row.pairs is not None else []:
            if p["i"] in place and p["j"] in place and p["i"] != p["j"]:
                succ[place[p["i"]]].append(place[p["j"]])
        alive = np.ones(len(succ), bool)
        total = left = int(_left(succ, alive[:, None])[0])
        step = 0
        while left > math.ceil(theta * total):
            free = np.flatnonzero(alive)
            tried = np.repeat(alive[:, None], len(free), axis=1)
            tried[free, np.arange(len(free))] = False
            counts = _left(succ, tried)
            best = int(counts.argmin())
            alive[free[best]], left, step = False, int(counts[best]), step + 1
            out.append((row.doc_id, step, int(row.ids[free[best]]), left))
    return out


def greedy_removal(nodes: DataFrame, edges: DataFrame, theta: float = THETA) -> DataFrame:
    """`doc_id`, `step`, `event_no`, `pairs_left`: one by one the event that leaves the fewest pairs, until few enough are left.

    Documents of any number of events; one step's work grows with the events times the edges times the words of a bit set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(_greedy(pdf, theta), columns=["doc_id", "step", "event_no", "pairs_left"])

    return adjacency(nodes, edges).mapInPandas(run, "doc_id long, step long, event_no long, pairs_left long")


def removal_frequency(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """`doc_id`, `event_no`, `c0`: how many sets hold the event, over the most in its document; 0 without sets."""
    hits = sets.select("doc_id", F.explode("members").alias("event_no")).groupBy("doc_id", "event_no").agg(F.count("*").alias("n"))
    rows = nodes.select("doc_id", "event_no").join(hits, ["doc_id", "event_no"], "left")
    most = F.max("n").over(Window.partitionBy("doc_id"))
    return rows.select("doc_id", "event_no", F.coalesce(F.col("n") / most, F.lit(0.0)).alias("c0"))


def member_labels(c0: DataFrame) -> DataFrame:
    """`c0` with `member`: 1 if the event is in a set."""
    return c0.withColumn("member", F.when(F.col("c0") > MEMBER_ABOVE, 1.0).otherwise(0.0))


def neighbor_propagation(edges: DataFrame, c0: DataFrame) -> DataFrame:
    """`c0` (doc_id, event_no, c0) with `s_nd`: for events in no set, the sum of c0 / degree over their member neighbours, each direction by
    itself, and with `degree` and `reach_local_proxy`, on which labels depend too. All from one pass over a document."""
    small, large = by_size(c0, edges, "c0")

    def work(table: pa.Table) -> pa.Table:
        g = bt.graphs_of(table)
        at = np.flatnonzero(g.rows >= 0)
        found = features_of(g)
        share = np.zeros(g.n)
        share[at] = bt.numbers(table, "c0")[g.rows[at]]
        weight = np.where(share > MEMBER_ABOVE, share / np.maximum(1, found["degree"]), 0.0)
        near = bt.segment_sum(weight[g.src], g.dst, g.n) + bt.segment_sum(weight[g.dst], g.src, g.n)
        columns = share, np.where(share > MEMBER_ABOVE, 0.0, near), found["degree"], found["reach_local_proxy"]
        return pa.table([*g.ids(at), *(pa.array(c[at]) for c in columns)], list(LABEL_INPUTS))

    out = bt.whole_documents(small, work, "doc_id long, event_no long, c0 double, s_nd double, degree long, reach_local_proxy long")
    if large is None:
        return out
    return out.unionByName(_propagation_by_joins(large.where("j IS NULL").select("doc_id", F.col("i").alias("event_no"), "c0"), large.where("j IS NOT NULL").select("doc_id", "i", "j")))


#: Columns that labels are made of.
LABEL_INPUTS = ("doc_id", "event_no", "c0", "s_nd", "degree", "reach_local_proxy")


def _propagation_by_joins(c0: DataFrame, edges: DataFrame) -> DataFrame:
    c0, key = stored(c0), ["doc_id", "event_no"]
    found = stored(features_by_joins(c0, edges).select(*key, "degree", "reach_local_proxy"))
    weight = c0.where(F.col("c0") > MEMBER_ABOVE).join(found, key).select("doc_id", F.col("event_no").alias("u"), (F.col("c0") / F.greatest(F.lit(1), F.col("degree"))).alias("w"))
    both = edges.select("doc_id", F.col("i").alias("u"), F.col("j").alias("event_no")).union(edges.select("doc_id", F.col("j").alias("u"), F.col("i").alias("event_no")))
    sums = both.join(weight, ["doc_id", "u"]).groupBy(*key).agg(F.sum("w").alias("s"))
    rows = c0.join(sums, key, "left").join(found, key)
    return rows.withColumn("s_nd", F.when(F.col("c0") > MEMBER_ABOVE, 0.0).otherwise(F.coalesce("s", F.lit(0.0)))).select(*LABEL_INPUTS)


def tier_rank_labels(scores: DataFrame) -> DataFrame:
    """`scores` (doc_id, event_no, c0, s_nd, degree, reach_local_proxy) with `member` and `rank_label`.

    Events in no set get up to 0.3, members 0.7 to 1, by the first place of their tie in the order of (s_nd, degree), or of
    (c0, degree, reach_local_proxy). Scores are rounded to 9 places first, so sums in another order tie all the same.
    """
    rows = member_labels(scores)
    inner = F.col("member") == 1.0
    order = Window.partitionBy("doc_id", "member").orderBy(F.round(F.when(inner, F.col("c0")).otherwise(F.col("s_nd")), PLACES), "degree", F.when(inner, F.col("reach_local_proxy")).otherwise(F.lit(0)))
    share = F.rank().over(order) / F.count("*").over(Window.partitionBy("doc_id", "member"))
    return rows.withColumn("rank_label", F.when(inner, HIGH_TIER + LOW_TIER * share).otherwise(LOW_TIER * share))


def ground_truth(nodes: DataFrame, edges: DataFrame, theta: float = THETA, min_nodes: int = MIN_NODES, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels (`c0`, `s_nd`, `member`, `rank_label`), removal sets, and a row of statistics for each document in the size band."""
    sets = stored(minimal_removal_sets(nodes, edges, theta, min_nodes, max_nodes))
    stats = sets.groupBy("doc_id").agg(F.max("k").alias("k"), F.max("original_pairs").alias("original_pairs"), F.max("final_pairs").alias("final_pairs"), F.count_if(F.size("members") > 0).alias("n_sets"))
    band = nodes.join(stats.select("doc_id"), "doc_id", "left_semi")
    own = edges.join(stats.select("doc_id"), "doc_id", "left_semi")
    c0 = removal_frequency(band, sets)
    return tier_rank_labels(neighbor_propagation(own, c0)).select("doc_id", "event_no", "c0", "s_nd", "member", "rank_label"), sets, stats
