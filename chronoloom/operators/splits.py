"""Size bands, splits, samples, and augmented views. Random choices come from md5 of a seed and the row's key, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.storage import ranked, uniform

#: Bands of sizes, share and seed of the test split, rates at which views lose edges and components.
MIN_NODES, MAX_NODES = 3, 30
TEST_RATIO, SEED = 0.2, 42
VIEW_RATES = {"v1a": {"temporal": 0.20, "causal": 0.20}, "v1b": {"temporal": 0.20, "causal": 0.20}, "v2": {"temporal": 0.60, "causal": 0.10}}
MASK_RATE = 0.15
MASKED_VIEWS = ("v1a", "v1b")


def size_bands(sizes: DataFrame) -> DataFrame:
    """`band` (skipped, labeled, inference_only) and `scored` of documents by `n_nodes`."""
    n = F.col("n_nodes")
    return sizes.withColumn("band", F.when(n < MIN_NODES, "skipped").when(n <= MAX_NODES, "labeled").otherwise("inference_only")).withColumn("scored", n >= MIN_NODES)


def shuffled(docs: DataFrame, seed: int) -> DataFrame:
    """`doc_id`, `rank` in a seeded order, `total`."""
    keyed = docs.select("doc_id", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))).alias("key"))
    return ranked(keyed, "key", "doc_id").select("doc_id", "rank", "total")


def train_test_split(docs: DataFrame, ratio: float = TEST_RATIO, seed: int = SEED) -> DataFrame:
    """`doc_id`, `split`: round-half-even(n * ratio) documents are test, 1 at least; 1 if that would be all of several."""
    n = F.greatest(F.lit(1), F.bround(F.col("total") * ratio).cast("long"))
    n = F.when((F.col("total") > 1) & (n >= F.col("total")), 1).otherwise(n)
    return shuffled(docs, seed).select("doc_id", F.when(F.col("rank") <= n, "test").otherwise("train").alias("split"))


def kfold(docs: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """`doc_id`, `fold` from 0: sizes differ by one at most, the first ones are larger."""
    size, more = F.floor(F.col("total") / k), F.col("total") % k
    place = F.col("rank") - 1
    large = more * (size + 1)
    fold = F.when(place < large, F.floor(place / (size + 1))).otherwise(more + F.floor((place - large) / F.greatest(F.lit(1), size)))
    return shuffled(docs, seed).select("doc_id", fold.cast("long").alias("fold"))


def split_manifest(sizes: DataFrame, labels: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`doc_id`, `n_nodes`, `band`, `split` of every document, and counts by split. In the labeled band, a document without labels
    or that failed is `failed`, the others are split."""
    rows = size_bands(sizes)
    good = labels.select("doc_id").distinct().join(failed.select("doc_id"), "doc_id", "left_anti")
    split = train_test_split(rows.where("band = 'labeled'").select("doc_id").join(good, "doc_id", "left_semi"))
    rows = rows.join(split, "doc_id", "left")
    named = F.when(F.col("band") == "labeled", F.coalesce("split", F.lit("failed"))).otherwise(F.col("band"))
    rows = rows.select("doc_id", "n_nodes", "band", named.alias("split"))
    return rows, rows.groupBy("split").agg(F.count("*").alias("n"))


def assemble_samples(features: DataFrame, labels: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features with labels of the documents in `ids`; and the documents that lack labels, features or a graph (the first of these)."""
    have = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    docs = ids.select("doc_id").join(have(labels, "l"), "doc_id", "left").join(have(features, "f"), "doc_id", "left").join(have(edges, "g"), "doc_id", "left")
    docs = docs.withColumn("reason", F.when(F.col("l").isNull(), "no labels").when(F.col("f").isNull(), "no features").when(F.col("g").isNull(), "no graph"))
    rows = features.join(labels, ["doc_id", "event_no"]).join(docs.where("reason IS NULL").select("doc_id"), "doc_id", "left_semi")
    return rows, docs.where("reason IS NOT NULL").select("doc_id", "reason")


def attach_vectors(nodes: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their embedding; and the documents without any."""
    rows = nodes.join(vectors.select("doc_id", "event_no", "embedding"), ["doc_id", "event_no"])
    return rows, nodes.select("doc_id").distinct().join(vectors.select("doc_id").distinct(), "doc_id", "left_anti")


def _edge_key(seed: int, view: Column) -> Column:
    return uniform(F.lit(seed), view, F.col("doc_id"), F.col("src"), F.col("dst"), F.col("rel"))


def drop_edges_by_type(typed: DataFrame, rates: dict[int, float], seed: int = SEED, view: str = "v") -> DataFrame:
    """Edges that stay when each relation loses the given share; each direction is drawn by itself, unlisted relations stay."""
    rate = F.lit(0.0)
    for rel, r in rates.items():
        rate = F.when(F.col("rel") == rel, F.lit(r)).otherwise(rate)
    return typed.where(_edge_key(seed, F.lit(view)) >= rate)


def mask_vectors(vectors: DataFrame, rate: float = MASK_RATE, seed: int = SEED, view: str = "v") -> DataFrame:
    """`embedding` with components set to 0, each with probability `rate`."""
    masked = F.transform("embedding", lambda x, i: F.when(uniform(F.lit(seed), F.lit(view), F.col("doc_id"), F.col("event_no"), i) < rate, F.lit(0.0)).otherwise(x.cast("double")))
    return vectors.withColumn("embedding", masked)


def augmented_views(typed: DataFrame, vectors: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Edges and vectors of the three views, tagged by `view`."""
    edges, vecs = None, None
    for view, rates in VIEW_RATES.items():
        e = drop_edges_by_type(typed, {0: rates["temporal"], 1: rates["temporal"], 2: rates["causal"], 3: rates["causal"]}, seed, view).withColumn("view", F.lit(view))
        v = (mask_vectors(vectors, MASK_RATE, seed, view) if view in MASKED_VIEWS else vectors.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))).withColumn("view", F.lit(view))
        edges, vecs = (e, v) if edges is None else (edges.unionByName(e), vecs.unionByName(v))
    return edges, vecs
