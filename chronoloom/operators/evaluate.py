"""Evaluation of scores against labels and removal sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import batches as bt

#: A score above this predicts a member, a label above that is one.
PREDICTED_ABOVE, TRUE_ABOVE = 0.7, 0.5


def _places(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Dense ranks, from each document's on: later documents have larger ones."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def inversions(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Pairs of each document of which the earlier value is larger, by merging: halves of 1, 2, 4, ... values meet, and each value of a right half
    counts the larger ones of its left half. `values` of later documents are larger, so halves may cross documents."""
    n = len(values)
    out = np.zeros(n_docs, np.int64)
    place, base = np.arange(n), np.int64(values.max(initial=0) + 1)
    width = 1
    while width < n:
        block, right = place // (2 * width), place // width % 2 == 1
        left = np.sort(block[~right] * base + values[~right])
        own = block[right]
        larger = np.searchsorted(left, (own + 1) * base) - np.searchsorted(left, own * base + values[right], "right")
        out += np.bincount(doc[right], larger, n_docs).astype(np.int64)
        width *= 2
    return out


def _pairs(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Pairs of equal keys in each document; equal keys are of one document."""
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    return np.bincount(doc[first], count * (count - 1) // 2, n_docs).astype(np.int64)


def kendall_tau(rows: DataFrame) -> DataFrame:
    """`doc_id`, `tau` from (doc_id, event_no, score, label): concordant less discordant over all pairs, ties 0, 0 below two events.

    Discordant pairs are inversions, counted by merging in n log n; pairs that tie in either column are counted apart, so no pair is ever a
    row. Rows with a null count for no pair.
    """

    def work(table: pa.Table) -> pa.Table:
        doc = bt.places(table)
        head = bt.runs_of(doc)[:-1]
        n = len(head)
        score, label = (table.column(c).cast(pa.float64()) for c in ("score", "label"))
        known = ~(score.is_null().to_numpy() | label.is_null().to_numpy())
        d = doc[known]
        s, v = (_places(x.fill_null(0).to_numpy()[known], d) for x in (score, label))
        order = np.lexsort((v, s))
        size = np.bincount(d, minlength=n)
        pairs = size * (size - 1) // 2
        both = _pairs(s * np.int64(v.max(initial=0) + 1) + v, d, n)
        tied = _pairs(s, d, n) + _pairs(v, d, n) - both
        tau = (pairs - tied - 2 * inversions(v[order], d[order], n)) / np.maximum(1, pairs)
        return pa.table([table.column("doc_id").combine_chunks().take(pa.array(head)), pa.array(tau)], ["doc_id", "tau"])

    return bt.whole_documents(rows.select("doc_id", "score", "label"), work, "doc_id long, tau double")


def mse_by_doc(rows: DataFrame) -> DataFrame:
    """`doc_id`, `mse`: the mean squared difference of score and label."""
    return rows.groupBy("doc_id").agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("mse"))


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`tp`, `fp`, `fn`, `tn`, `precision`, `recall`, `f1` over all events (or by key); 0 over an empty denominator."""
    said, true = F.col("score") > PREDICTED_ABOVE, F.col("member") > TRUE_ABOVE
    counts = rows.groupBy(*(by or [])).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = counts.withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("tp") + F.col("fn")))
    return counts.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_set_hit(scores: DataFrame, sets: DataFrame, tie_by: str = "event_id") -> DataFrame:
    """`doc_id`, `hit`, `set_no`: the largest share of a set inside the top as many events by score, and the first such set (null if none hits).

    Equal scores go by `tie_by`: the id as a string, or `event_no`.
    """
    ranks = scores.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), tie_by))).select("doc_id", "event_no", "rank")
    rows = sets.where(F.size("members") > 0).select("doc_id", "set_no", F.size("members").alias("size"), F.explode("members").alias("event_no"))
    rates = rows.join(ranks, ["doc_id", "event_no"], "left").groupBy("doc_id", "set_no", "size").agg(F.count_if(F.col("rank") <= F.col("size")).alias("n")).withColumn("hit", F.col("n") / F.col("size"))
    best = rates.groupBy("doc_id").agg(F.max("hit").alias("hit"), F.max_by("set_no", F.struct("hit", -F.col("set_no"))).alias("set_no"))
    return best.select("doc_id", "hit", F.when(F.col("hit") > 0, F.col("set_no")).alias("set_no"))


def hit_summary(hits: DataFrame, splits: DataFrame) -> DataFrame:
    """`split`, counts of documents that are hit in full, in part, or missed, and their percentages: for each split and for all."""
    rows = hits.join(splits.select("doc_id", "split"), "doc_id").withColumn("split", F.explode(F.array(F.col("split"), F.lit("all"))))
    hit = F.col("hit")
    counts = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(hit == 1).alias("n_full"), F.count_if((hit > 0) & (hit < 1)).alias("n_partial"), F.count_if(hit == 0).alias("n_miss"))
    return counts.withColumns({f"pct_{k}": 100.0 * F.col(f"n_{k}") / F.col("n") for k in ("full", "partial", "miss")})


def missed_documents(hits: DataFrame, splits: DataFrame) -> DataFrame:
    """`doc_id`, `split` of the documents of which no set is hit."""
    return hits.where("hit = 0").join(splits, "doc_id").select("doc_id", "split")


def rank_comparison(labels: DataFrame, scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Events of the documents by true rank, with the model's score (0 if missing) and rank (null if missing)."""
    order = lambda c: Window.partitionBy("doc_id").orderBy(F.desc(c), "event_id")
    true = labels.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("true_rank", F.row_number().over(order("label")).cast("long"))
    model = scores.withColumn("model_rank", F.row_number().over(order("score")).cast("long")).select("doc_id", "event_id", "score", "model_rank")
    return true.join(model, ["doc_id", "event_id"], "left").na.fill(0.0, ["score"]).select("doc_id", "true_rank", "event_id", "label", "model_rank", "score")


def inference_ranking(scores: DataFrame, sizes: DataFrame, above: int = 30) -> DataFrame:
    """Rank and score of events of documents too large for labels."""
    large = sizes.where(F.col("n_nodes") > above).select("doc_id")
    rows = scores.join(large, "doc_id", "left_semi")
    return rows.select("doc_id", "event_id", "score", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "event_id")).cast("long").alias("rank"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of loss and F1, mean tau, pooled hits and counts of (fold, loss, f1, tau, hits, docs, tp, fp, fn, tn)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    return folds.agg(F.avg("loss").alias("loss_mean"), F.stddev_pop("loss").alias("loss_std"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.avg("tau").alias("tau_mean"), (F.sum("hits") / F.sum("docs")).alias("hit_rate"), *sums)


def seed_summary(folds: DataFrame) -> DataFrame:
    """The same over seeds: hit rates pooled inside a seed, then means and population deviations over seeds."""
    seeds = folds.groupBy("seed").agg((F.sum("hits") / F.sum("docs")).alias("hit"), F.avg("tau").alias("tau"), F.avg("f1").alias("f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    parts = [x for c, n in (("hit", "hit_rate"), ("tau", "tau"), ("f1", "f1")) for x in (F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"))]
    return seeds.agg(F.count("*").alias("n_seeds"), *parts, *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


#: Numbers in one block of a sum, 512 KB, and groups of tasks whose sums are added first.
BLOCK_NUMBERS, GROUPS = 1 << 16, 64
SUMS = "what string, block int, part int, n long, x binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of packed blocks that stand together; one block is held at a time."""
    key, total, n = None, np.zeros(0), 0
    schema = pa.schema([("what", pa.string()), ("block", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            own = row["what"], row["block"], row["part"]
            if own != key:
                if key:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, n, total.tobytes()), strict=True))], schema=schema)
                key, total, n = own, np.zeros(len(row["x"]) // 8), 0
            total = total + np.frombuffer(row["x"])
            n += row["n"]
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, n, total.tobytes()), strict=True))], schema=schema)


def _view_sums(views: DataFrame, names: list[str]) -> DataFrame:
    """Sums of the vectors of each view, of their products, and of squared differences of views, packed in blocks.

    A task adds up its rows and hands on a binary row for each block; these are added by groups of tasks, then all together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(len(names))[0].as_py() % GROUPS
            x = {n: c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for n, c in zip(names, batch.columns, strict=False)}
            rows += batch.num_rows
            for n, v in x.items():
                sums[f"sum {n}"] = sums.get(f"sum {n}", 0) + v.sum(axis=0)
                sums[f"product {n}"] = sums.get(f"product {n}", 0) + (v.T @ v).ravel()
            for a, b in zip(names, names[1:], strict=False):
                sums[f"square {a} {b}"] = sums.get(f"square {a} {b}", 0) + ((x[a] - x[b]) ** 2).sum(axis=0)
        for what, value in sums.items():
            for block in range(0, len(value), BLOCK_NUMBERS):
                packed = np.ascontiguousarray(value[block : block + BLOCK_NUMBERS]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([what]), pa.array([block // BLOCK_NUMBERS], pa.int32()), pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([packed], pa.binary())], names=["what", "block", "part", "n", "x"])

    out = views.withColumn("part", F.spark_partition_id()).mapInArrow(run, SUMS)
    for part in (F.col("part"), F.lit(0).cast("int")):
        out = out.withColumn("part", part).repartition("what", "block", "part").sortWithinPartitions("what", "block", "part").mapInArrow(_added, SUMS)
    return out


def _agreement(sums: dict[str, np.ndarray], n: int, a: str, b: str, gamma: float) -> tuple[float, float, float, float]:
    size = len(sums[f"sum {a}"])
    variance, covariance = [], []
    for v in (a, b):
        mean = sums[f"sum {v}"] / n
        cov = (sums[f"product {v}"].reshape(size, size) - n * np.outer(mean, mean)) / max(1, n - 1)
        diagonal = np.diag(cov).copy()
        variance.append(np.maximum(0, gamma - np.sqrt(diagonal + 1e-4)).mean())
        covariance.append(((cov**2).sum() - (diagonal**2).sum()) / size)
    parts = float(sums[f"square {a} {b}"].sum() / (n * size)), float(np.mean(variance)), float(np.mean(covariance))
    return *parts, 25 * parts[0] + 25 * parts[1] + parts[2]


PARTS = ("invariance", "variance", "covariance", "loss")


def _views(spark: SparkSession, tables: list[DataFrame], gamma: float) -> list[tuple[float, float, float, float]] | None:
    """The agreement of each view with the next one; only sums of D x D numbers come to the driver."""
    key = ["doc_id", "event_no"]
    names = [f"v{k}" for k in range(len(tables))]
    rows = tables[0].select(*key, F.col("embedding").alias("v0"))
    for name, t in zip(names[1:], tables[1:], strict=True):
        rows = rows.join(t.select(*key, F.col("embedding").alias(name)), key)
    found = _view_sums(rows.select(*names), names).toPandas()
    if not len(found):
        return None
    sums = {what: np.concatenate([np.frombuffer(x) for x in g.sort_values("block")["x"]]) for what, g in found.groupby("what")}
    return [_agreement(sums, int(found["n"].iloc[0]), a, b, gamma) for a, b in zip(names, names[1:], strict=False)]


def view_agreement(a: DataFrame, b: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row from two views (doc_id, event_no, embedding): `invariance` (mean squared difference), `variance` (mean of
    relu(gamma - sqrt(var + 1e-4)), averaged over views), `covariance` (squared off-diagonal covariances over D, averaged), `loss`
    (25, 25 and 1 times these); no row without vectors. Each task adds up one D x D matrix of each view, in packed blocks."""
    found = _views(a.sparkSession, [a, b], gamma)
    return a.sparkSession.createDataFrame(found or [], ", ".join(f"{c} double" for c in PARTS))


def three_view_loss(v1a: DataFrame, v1b: DataFrame, v2: DataFrame, beta: float = 0.5, gamma: float = 1.0) -> DataFrame:
    """One row: the agreement of the first two views (`robust_...`), of the second with the third (`causal_...`), and `total`, the first
    loss and `beta` times the second."""
    found = _views(v1a.sparkSession, [v1a, v1b, v2], gamma)
    names = [f"{k}_{c}" for k in ("robust", "causal") for c in PARTS] + ["total"]
    rows = [(*found[0], *found[1], found[0][3] + beta * found[1][3])] if found else []
    return v1a.sparkSession.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
