"""Quality rules: base counts of a text, and a hashed n-gram logistic regression learnt from labelled quality rows.

The model has three blocks of hashed features, words, word pairs and runs of four bytes, each as shares of the text. It is
fitted on a bounded sample of labelled rows (`MOST_LABELLED` rows and `MOST_BYTES` of features), its scores are turned into
probabilities on a part held out of the fit, and texts are scored in Arrow batches against a fixed threshold.

Defined results: a null text has no words; a null label is not learnt from; of several labels of one id the largest counts, of
several texts of one id that with the smallest hash is learnt from; without rows of both classes there is no
model, the probability is null and the base rules alone decide; repeated rows get the same result each; columns other than
the id and the text are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

#: Labelled rows that are learnt from at most, those of the smallest hash of the id.
MOST_LABELLED = 4000
#: Bytes of their features that come to the driver at most: the rows that fit, in the order of the hash. 4000 rows of 2 KB of text
#: have about 40 MB.
MOST_BYTES = 64 << 20
#: Features that a step of the fit multiplies at a time.
TOGETHER = 1 << 20
#: Hash buckets of each of the three blocks.
BUCKETS = 1 << 15
#: A text is kept if its probability of good quality reaches this.
THRESHOLD = 0.5
#: Base limits: fewest words, and the largest percentage of words in repeated windows.
FEWEST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Shares are small numbers; the features are shares times this.
SCALE = 30.0

BASE = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType())]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in windows of five that stand more than once."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # splits at the six ASCII blanks alone
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    repeated = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            end = 0
            for i, window in enumerate(windows):
                if count[window] > 1:
                    repeated += i + WINDOW - max(end, i)
                    end = i + WINDOW
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), lines, repeated


def _blocks(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block the buckets in text order, and the first and last of each row among them."""
    mask = np.uint64(BUCKETS - 1)
    starts, ends, bounds = tx.word_bounds(data, offsets, ~tx.BLANK)
    words = tx.span_hash(tx.prefix_hash(data), starts, ends)
    pairs = tx.mix(words * np.uint64(3) + np.append(words[1:], np.zeros(1, np.uint64))[: len(words)])
    v = np.zeros(len(data) + 4, np.uint32)
    v[: len(data)] = data
    grams = ((v[:-3] | v[1:-2] << np.uint32(8) | v[2:-1] << np.uint32(16) | v[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return [
        ((words & mask).astype(np.int32), bounds[:-1], bounds[1:]),
        ((pairs & mask).astype(np.int32) + BUCKETS, bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - 1)),
        (grams.astype(np.int32) + 2 * BUCKETS, offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - 3)),
    ]


def _features(part: pa.RecordBatch) -> dict[str, object]:
    """Sparse features of each row, as bytes of int32 buckets and float32 values."""
    column = part.column(part.schema.get_field_index("text"))
    index, value = [[] for _ in range(len(column))], [[] for _ in range(len(column))]
    for buckets, first, last in _blocks(*tx.utf8(column)):
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            found, times = np.unique(buckets[a:b], return_counts=True)
            index[i].append(found.astype(np.int32))
            value[i].append((times * (SCALE / max(1, b - a))).astype(np.float32))
    return {"buckets": [np.concatenate(x).tobytes() for x in index], "shares": [np.concatenate(x).tobytes() for x in value]}


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """The model from labelled rows (`doc_id`, `quality`) and their texts; None without rows of both classes.

    The labelled sample is bounded by `most`, so joining it to the documents needs no shuffle of texts, and the rows that
    come to the driver are bounded as well.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = tx.map_text(rows.withColumn("hash", F.xxhash64("text")), "text", _features, [T.StructField("buckets", T.BinaryType()), T.StructField("shares", T.BinaryType())], ["doc_id", "quality", "hash"])
    one = F.min_by(F.struct("quality", "buckets", "shares"), "hash")  # of rows with equal ids; partial, so a repeated id is no hot key
    made = tx.stored(rows.groupBy("doc_id").agg(one.alias("x")).select("doc_id", "x.*"))
    sizes = made.select("doc_id", F.octet_length("buckets").alias("n"), F.xxhash64("doc_id").alias("order")).collect()  # `most` rows of numbers
    fits, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["order"], r["doc_id"])):
        total += 2 * r["n"]
        if fits and total > MOST_BYTES:
            break
        fits.append((r["doc_id"],))
    if not fits:
        return None
    chosen = documents.sparkSession.createDataFrame(fits, T.StructType([made.schema["doc_id"]]))
    rows = made.join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([float(r["quality"] > 0) for r in rows])
    if len(set(y)) < 2:
        return None
    held = np.array([(r["doc_id"] * 2654435761 >> 7) % 4 == 0 for r in rows])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 2 == 0 if len(y) > 3 else np.zeros(len(y), bool)
    bounds = np.concatenate([[0], np.cumsum([len(r["buckets"]) // 4 for r in rows])])
    column = np.frombuffer(b"".join(r["buckets"] for r in rows), np.int32)
    value = np.frombuffer(b"".join(r["shares"] for r in rows), np.float32)
    del rows
    weights, bias = _descend(bounds, column, value, y, ~held)
    margin = _margins(bounds, column, value, weights) + bias
    slope, offset = _calibrate(margin[held], y[held]) if len(set(y[held])) == 2 else (1.0, 0.0)
    return Model(weights.astype(np.float32), bias, slope, offset)


def _steps(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive rows with about `TOGETHER` features."""
    cuts = np.unique(np.searchsorted(bounds, np.arange(0, bounds[-1] + TOGETHER, TOGETHER)).clip(0, len(bounds) - 1))
    cuts = np.unique(np.append(cuts, [0, len(bounds) - 1]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _margins(bounds: np.ndarray, column: np.ndarray, value: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weighted sum of each row's features."""
    out = np.zeros(len(bounds) - 1)
    for a, b in _steps(bounds):
        part = slice(bounds[a], bounds[b])
        total = np.concatenate([[0.0], np.cumsum(w[column[part]] * value[part])])
        out[a:b] = total[bounds[a + 1 : b + 1] - bounds[a]] - total[bounds[a:b] - bounds[a]]
    return out


def _descend(bounds: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the logistic loss over the rows in `use`, by Adam on the whole sample."""
    n, total = 3 * BUCKETS, max(1, int(use.sum()))
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    bias, mb, vb = 0.0, 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_margins(bounds, column, value, w) + bias, -30, 30)))
        off = np.where(use, p - y, 0.0) / total
        g = decay * w
        for a, b in _steps(bounds):
            part = slice(bounds[a], bounds[b])
            g += np.bincount(column[part], np.repeat(off[a:b], np.diff(bounds[a : b + 1])) * value[part], n)
        gb = off.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        bias -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, float(bias)


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins probabilities (Platt), by Newton steps on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        ga, gb = (d * margin).sum() + 1e-3 * (a - 1), d.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / (abs(da) + abs(db) + 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of good quality of each row of a slice."""
    margin = np.full(len(offsets) - 1, model.bias)
    for buckets, first, last in _blocks(data, offsets):
        total = np.zeros(len(buckets) + 1)
        np.cumsum(model.weights[buckets], dtype=np.float64, out=total[1:])
        margin += SCALE * (total[last] - total[first]) / np.maximum(1, last - first)
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))


def score(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, the base counts, `base_failed`, `kept`, and `quality_probability` of every row of `documents`."""

    def work(part: pa.RecordBatch) -> dict[str, object]:
        column = part.column(part.schema.get_field_index("text"))
        counts = np.array([base_counts(t) for t in column.to_pylist()], np.int64).reshape(-1, 5)
        failed = (counts[:, 0] < FEWEST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
        p = probabilities(model, *tx.utf8(column)) if model else None
        kept = ~failed & (p >= threshold) if model else ~failed
        out = {f.name: counts[:, i] for i, f in enumerate(BASE[:5])}
        return out | {"base_failed": failed, "kept": kept, "quality_probability": pa.array(p) if model else pa.nulls(len(column), pa.float64())}

    fields = [*BASE, T.StructField("kept", T.BooleanType()), T.StructField("quality_probability", T.DoubleType())]
    return tx.map_text(documents, "text", work, fields, ["doc_id"])
