"""Merkle manifest of a dataset, by time-forward processing.

Each row is a leaf, each source a tree of runs of three, and the sources' roots, in order, a tree of their own. A node is labelled by
its tree, height and place, so that children come before parents. Digests travel as messages to a label: the shuffle, sorted by label
and spilling to disk, is the external queue that brings all messages of a block of labels to one task; inside a block a heap hands
them over, smallest label first. A block holds six heights, 729 nodes at most, so a tree of n leaves takes log(n) / log(729) rounds,
and a source that holds a third of all rows is as many blocks as its size needs. A reversed sweep then goes from the roots to
the leaves: a block gets one message with its node's proof from there to the root, the proof's suffix, and hands each node its own.

Only digests, ids and sources are shuffled, never texts.

Defined results: fields that are null count as `-`; a null id comes first in its source and is never tampered with; a null source
comes before all others; rows with equal ids are ordered by their leaves, equal rows are leaves of their own; without siblings the
proof is that of no input; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

#: Nodes of a run, and heights of a block.
RUN, HEIGHTS = 3, 6
#: The fields of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The order of a tree's nodes in messages: first the suffix that its block gets.
HEAD = -1


def leaf_digest(columns: dict[str, Column]) -> Column:
    """H of the fields, each with its length in bytes."""
    parts = []
    for name in FIELDS:
        value = columns[name].cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))]
    return F.sha2(F.concat(*parts), 256)


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def swept(digests: list[str], total: int, most: int) -> list[list[str]]:
    """All nodes of a block by height, from its lowest ones up: `most` heights to its root, or to the tree's where the tree ends in this block.

    The queue holds messages (height, place of the parent, place of the child, digest); those to the smallest label are due.
    """
    top = 0
    while top < most and -(-total // RUN**top) > 1:
        top += 1
    heights: list[list[str]] = [digests] + [[] for _ in range(top)]
    queue = [(1, i // RUN, i, d) for i, d in enumerate(digests)] if top else []  # in order, so a heap already
    while queue:
        height, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (height, place):
            children.append(heapq.heappop(queue)[3])
        digest = joined(children)
        heights[height].append(digest)
        if height < top:
            heapq.heappush(queue, (height + 1, place // RUN, place, digest))
    return heights


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The messages of one block after another, from rows sorted by tree, block and place."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, block in groupby(rows, lambda r: (r["tree"], r["block"])):
        yield key, list(block)


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


#: Rows in one Arrow batch of results.
TOGETHER = 10_000


def _sent(nodes: DataFrame) -> DataFrame:
    """Messages in the order of their labels, a block in one task."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _raised(nodes: DataFrame, most: int) -> DataFrame:
    """The nodes `most` heights above `nodes` (tree, place, total, digest), in the same columns."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, block), rows in _blocks(batches):
            total = rows[0]["total"]
            out.append((tree, block, -(-total // RUN**most), swept([r["digest"] for r in rows], total, most)[-1][0]))
            if len(out) >= TOGETHER:
                yield _out(out, schema)
                out = []
        yield _out(out, schema)

    labelled = nodes.select("tree", F.expr(f"place div {RUN**most}").alias("block"), "place", "total", "digest")
    return _sent(labelled).mapInArrow(run, "tree string, place long, total long, digest string")


def trees(nodes: DataFrame, largest: int, most: int) -> list[DataFrame]:
    """`nodes` and, round by round, the nodes above them up to the roots, which are the last table's. A tree that ended stays as it is."""
    tables = [nodes]
    while largest > 1:
        tables.append(tx.stored(_raised(tables[-1], most)))
        largest = -(-largest // RUN**most)
    return tables


def _handed(digests: list[str], total: int, suffix: str, most: int) -> Iterator[str]:
    """The proof of each lowest node of a block: for each height its own place in its run and the others' digests, then the suffix.

    A proof is text, `place:digest,digest;` for each height.
    """
    heights = swept(digests, total, most)
    for i in range(len(digests)):
        steps = []
        for nodes in heights[:-1]:
            own, first = i % RUN, i - i % RUN
            steps.append(f"{own}:{','.join(d for k, d in enumerate(nodes[first : first + RUN]) if k != own)};")
            i //= RUN
        yield "".join(steps) + suffix


def _lowered(nodes: DataFrame, proofs: DataFrame, most: int) -> DataFrame:
    """`tree`, `place`, `proof` of `nodes` from those (tree, place, proof) of the nodes `most` heights above."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("proof", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, _), (head, *rows) in _blocks(batches):
            out += [(tree, r["place"], p) for r, p in zip(rows, _handed([r["digest"] for r in rows], rows[0]["total"], head["proof"], most), strict=True)]
            if len(out) >= TOGETHER:
                yield _out(out, schema)
                out = []
        yield _out(out, schema)

    return _sent(_with_heads(nodes, proofs, most)).mapInArrow(run, "tree string, place long, proof string")


def _with_heads(nodes: DataFrame, proofs: DataFrame, most: int) -> DataFrame:
    """`nodes`, and before each block the message with its proof."""
    own = nodes.withColumn("block", F.expr(f"place div {RUN**most}")).withColumn("proof", F.lit(None).cast("string"))
    heads = proofs.select("tree", F.col("place").alias("block"), F.lit(HEAD).cast("long").alias("place"), "proof")
    return own.unionByName(heads, allowMissingColumns=True)


def folded(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for step in proof.split(";")[:-1]:
        own, _, others = step.partition(":")
        run = others.split(",") if others else []
        run.insert(int(own), leaf)
        leaf = joined(run)
    return leaf


def proof_digest(proof: str) -> str:
    """H of the siblings alone."""
    return joined([step.partition(":")[2].replace(",", "") for step in proof.split(";")])


def placed(rows: DataFrame, tree: str | None, *order: str) -> DataFrame:
    """`rows` with `place`, from 0 in the order of the given columns in each tree, and `total`, the tree's size.

    Rows are dealt by range over all columns, so a tree spreads over as many tasks as its size needs; what is added up are counts by
    tree and range. Without a `tree` all rows are one.
    """
    key = F.col(tree) if tree else F.lit(None).cast("string")
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in ([tree] if tree else []) + list(order)]
    rows = rows.withColumn("tree", key)
    dealt = rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("range", F.spark_partition_id())
    schema = dealt.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: object = run  # no tree yet
        at = 0
        for batch in batches:
            local = []
            for t in batch.column(batch.schema.get_field_index("tree")).to_pylist():
                at = at + 1 if t == before else 0
                before = t
                local.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "local"])

    local = tx.stored(dealt.mapInArrow(run, T.StructType([*schema.fields, T.StructField("local", T.LongType())])))
    counts = local.groupBy("tree", "range").agg((F.max("local") + 1).alias("n"))
    if tree:
        before, every = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    else:  # one row for each range
        before, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    counts = counts.select(F.col("tree").alias("_tree"), F.col("range").alias("_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(every).alias("total"))
    out = local.join(counts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("range") == F.col("_range")))
    return out.withColumn("place", F.col("_before") + F.col("local")).drop("_tree", "_range", "_before", "range", "local")


def build(documents: DataFrame, other: Column | None = None, most: int = HEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest: leaves (`source`, `doc_id`, `leaf`, `other`, `proof`), subroots (`source`, `subroot`) and the root (`root`).

    `other` is a digest that travels beside a row's leaf, such as that of a changed row, to be folded with the same proof. Texts are
    read once, for their digests.
    """
    beside = F.lit(None).cast("string") if other is None else other
    rows = tx.stored(documents.select("doc_id", "source", leaf_digest({c: documents[c] for c in FIELDS}).alias("digest"), beside.alias("other")))
    leaves = tx.stored(placed(rows, "source", "doc_id", "digest"))
    if (largest := leaves.agg(F.max("total")).first()[0]) is None:
        none = leaves.select("source", "doc_id", F.col("digest").alias("leaf"), "other", F.lit("").alias("proof"))
        return none, leaves.select("source", F.col("digest").alias("subroot")), leaves.select(F.col("digest").alias("root"))
    lower = trees(leaves.select("tree", "place", "total", "digest"), largest, most)
    subroots = lower[-1].select(F.col("tree").alias("source"), "digest")
    tops = tx.stored(placed(subroots, None, "source", "digest"))
    upper = trees(tops.select("tree", "place", "total", "digest"), tops.agg(F.max("total")).first()[0], most)
    root = upper[-1].select(F.col("digest").alias("root"))
    proofs = root.select(F.lit(None).cast("string").alias("tree"), F.lit(0).cast("long").alias("place"), F.lit("").alias("proof"))
    for nodes in reversed(upper[:-1]):
        proofs = tx.stored(_lowered(nodes, proofs, most))
    # each source's proof, to the place 0 of its tree
    heads = tops.select("source", F.col("place").alias("_place"), F.col("digest").alias("subroot")).join(proofs.select(F.col("place").alias("_place"), "proof"), "_place")
    proofs = heads.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "proof")
    for nodes in reversed(lower[1:-1]):
        proofs = tx.stored(_lowered(nodes, proofs, most))
    if len(lower) == 1:  # each tree is a single leaf
        found = leaves.join(proofs.select(F.col("tree").alias("_tree"), "proof"), F.col("tree").eqNullSafe(F.col("_tree")))
        return found.select("source", "doc_id", F.col("digest").alias("leaf"), "other", "proof"), subroots.select("source", F.col("digest").alias("subroot")), root
    schema = pa.schema([("source", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("other", pa.string()), ("proof", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, _), (head, *rows) in _blocks(batches):
            out += [(tree, r["doc_id"], r["digest"], r["other"], p) for r, p in zip(rows, _handed([r["digest"] for r in rows], rows[0]["total"], head["proof"], most), strict=True)]
            if len(out) >= TOGETHER:
                yield _out(out, schema)
                out = []
        yield _out(out, schema)

    found = _sent(_with_heads(leaves.select("tree", "place", "total", "digest", "doc_id", "other"), proofs, most)).mapInArrow(run, "source string, doc_id long, leaf string, other string, proof string")
    return found, subroots.select("source", F.col("digest").alias("subroot")), root


def verify(documents: DataFrame, tampered: Column | None = None, most: int = HEIGHTS) -> DataFrame:
    """`doc_id`, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root`, `verified` of every row.

    Where `tampered` is true the row is folded with the leaf of its text without line feeds. Each row's proof is folded anew.
    """
    changed = {c: documents[c] for c in FIELDS} | {"text": F.replace(documents["text"], F.lit("\n"), F.lit(""))}
    leaves, subroots, root = build(documents, None if tampered is None else F.when(tampered, leaf_digest(changed)), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            leaf, other, proof = (column[c].to_pylist() for c in ("leaf", "other", "proof"))
            own = [folded(x or y, p) for y, x, p in zip(leaf, other, proof, strict=True)]
            yield pa.RecordBatch.from_arrays([column["source"], column["doc_id"], column["leaf"], pa.array([proof_digest(p) for p in proof], pa.string()), pa.array(own, pa.string())], names=["source", "doc_id", "leaf", "proof_sha256", "folded_root"])

    rows = leaves.select("source", "doc_id", "leaf", "other", "proof").mapInArrow(run, "source string, doc_id long, leaf string, proof_sha256 string, folded_root string")
    # few rows beside the leaves: a source's root each; the one root is a literal
    top = root.first()
    named = rows.join(subroots.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    root_text = F.lit(top[0] if top else None).cast("string")
    return named.select("doc_id", "leaf", "subroot", root_text.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_text).alias("verified"))


def _levels(tree: str, source: str, order: str) -> str:
    """SQL of all nodes of trees, by height and place."""
    return f"""{tree} AS (SELECT {source} AS tree, 0 AS h, row_number() OVER (PARTITION BY {source} ORDER BY {order}) - 1 AS place, digest, count(*) OVER (PARTITION BY {source}) AS total FROM {tree}_of
  UNION ALL SELECT tree, h + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (total + 2) // 3 FROM {tree} WHERE total > 1 GROUP BY tree, h, place // 3, total)"""


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in FIELDS) + ")"
#: SQL of the unsigned CRC-32 of a decimal id, bit by bit; null for a null id.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
ORACLE_SQL = f"""
WITH RECURSIVE low_of AS (SELECT doc_id, coalesce('s' || source, '') AS name, {_LEAF} AS digest, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.replace("text", "replace(text, chr(10), '')")} ELSE {_LEAF} END AS other FROM documents),
{_levels("low", "name", "doc_id NULLS FIRST, digest")},
high_of AS (SELECT tree AS name, digest FROM low WHERE total = 1),
{_levels("high", "''", "name")},
leaves AS (SELECT doc_id, name, digest, other, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM low_of),
tops AS (SELECT name, digest, row_number() OVER (ORDER BY name) - 1 AS place FROM high_of),
height AS (SELECT tree, max(h) AS top FROM low GROUP BY tree),
steps AS (SELECT l.name, l.place, n.h AS step, n.place AS at, n.digest, (l.place // (3 ** n.h)::BIGINT) AS own FROM leaves l JOIN low n ON n.tree = l.name AND n.total > 1 AND n.place // 3 = l.place // (3 ** (n.h + 1))::BIGINT
  UNION ALL SELECT l.name, l.place, t.top + n.h, n.place, n.digest, s.place // (3 ** n.h)::BIGINT FROM leaves l JOIN tops s ON s.name = l.name JOIN height t ON t.tree = l.name JOIN high n ON n.total > 1 AND n.place // 3 = s.place // (3 ** (n.h + 1))::BIGINT),
proofs AS (SELECT l.name, l.place, sha256(coalesce(string_agg(s.digest, '' ORDER BY s.step, s.at) FILTER (WHERE s.at <> s.own), '')) AS proof_sha256 FROM leaves l LEFT JOIN steps s ON s.name = l.name AND s.place = l.place GROUP BY l.name, l.place),
fold AS (SELECT name, place, 0 AS step, other AS digest FROM leaves
  UNION ALL SELECT f.name, f.place, f.step + 1, sha256(string_agg(CASE WHEN s.at = s.own THEN f.digest ELSE s.digest END, '' ORDER BY s.at)) FROM fold f JOIN steps s ON s.name = f.name AND s.place = f.place AND s.step = f.step GROUP BY f.name, f.place, f.step)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, p.proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN tops t ON t.name = l.name JOIN (SELECT digest FROM high WHERE total = 1) r ON true JOIN proofs p ON p.name = l.name AND p.place = l.place
JOIN (SELECT name, place, arg_max(digest, step) AS digest FROM fold GROUP BY name, place) f ON f.name = l.name AND f.place = l.place
"""
