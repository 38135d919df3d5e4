"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases whose bounds depend on a few neighbouring symbols alone: runs of one symbol become one,
deterministic coin tossing turns symbols into labels below six that differ between neighbours, and a phrase starts at each
local maximum of the labels. A phrase's name is a hash of its symbols; the names are the symbols of the next level. Equal
substrings so get equal names inside, wherever they stand. The name of the whole text and the smallest hashes of the names
of the upper levels make the fingerprint; the share of common names among the smallest ones estimates the likeness of two
texts (Jaccard likeness of their sets of names).

Defined results: a null text is as an empty one; the fingerprint of the empty text is sixteen zeros and a colon, like only
to itself; equal texts have equal fingerprints; of rows with equal or null ids (null: smallest), the hash of the text
decides the order, and they are one range; a single row is its own next; extra columns are ignored. Run lengths are named exactly and
texts of a phrase or two have no upper names, so an edit of a very repetitive or short text may leave no common name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

#: Names that a fingerprint holds at most.
SKETCH = 64
#: Levels whose names count; the first is too common to tell texts apart.
FROM_LEVEL = 2
LEVELS = 40
#: Bytes of text in one range of ids.
RANGE_BYTES = 64 << 20


def _label(left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which neighbours differ, plus the bit there."""
    differ = left ^ own
    low = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
    return place * np.uint64(2) + (own >> place & np.uint64(1))


def _table(size: int) -> np.ndarray:
    """Labels of all pairs of symbols below `size`."""
    left, own = np.meshgrid(np.arange(size, dtype=np.uint64), np.arange(size, dtype=np.uint64), indexing="ij")
    return np.where(left == own, 0, _label(left, np.where(left == own, own ^ np.uint64(1), own))).astype(np.uint8)


_tables = {size: _table(size).ravel() for size in (256, 16)}


def _phrases(symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks where phrases start; neighbours differ within a row, `start` marks the rows' first symbols."""
    if symbols.dtype == np.uint8:
        left = np.empty_like(symbols)
        left[1:] = symbols[:-1]
        left[start] = ~symbols[start]
        label = _tables[256][left.astype(np.uint16) << np.uint16(8) | symbols]
        rounds = 2
    else:
        left = np.empty_like(symbols)
        left[1:] = symbols[:-1]
        left[start] = ~symbols[start]
        label = _label(left, symbols).astype(np.uint8)  # below 128
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[start] = label[start] ^ np.uint8(1)
        label = _tables[256][left.astype(np.uint16) << np.uint16(8) | label]
        rounds = 2
    for _ in range(rounds):  # below 16, 8, 6
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[start] = label[start] ^ np.uint8(1)
        label = _tables[16][left << np.uint8(4) | label]
    mark = start.copy()
    if len(label) > 2:
        mark[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~start[2:]
    return mark


def names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The name of each whole row (0: empty), and all names of the upper levels with their rows."""
    n = len(offsets) - 1
    root = np.zeros(n, np.uint64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    symbols: np.ndarray = data
    upper: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for level in range(LEVELS):
        if not len(symbols):
            break
        start = np.ones(len(row), bool)
        start[1:] = row[1:] != row[:-1]
        # runs of one symbol become one
        head = start.copy()
        head[1:] |= symbols[1:] != symbols[:-1]
        at = np.flatnonzero(head)
        run = np.diff(at, append=len(symbols))
        symbols, row, start = symbols[at], row[at], start[at]
        mark = _phrases(symbols, start)  # of the runs' symbols, which differ between neighbours whatever the runs' lengths
        wide = symbols.astype(np.uint64) + np.uint64(1) if symbols.dtype == np.uint8 else symbols
        wide = np.where(run > 1, tx.mix(wide * np.uint64(tx.BASE) + run.astype(np.uint64)), wide)
        at = np.flatnonzero(mark)
        length = np.diff(at, append=len(wide))
        place = np.arange(len(wide)) - np.repeat(at, length)
        symbols = tx.mix(np.add.reduceat(wide * tx.powers(tx.BASE, max(64, int(length.max())))[place], at) + np.uint64(level * 2 + 1))
        row = row[at]
        if level + 1 >= FROM_LEVEL:
            upper.append(symbols)
            rows.append(row)
        alone = np.bincount(row, minlength=n)
        done = alone[row] == 1
        root[row[done]] = symbols[done]
        symbols, row = symbols[~done], row[~done]
    return root, np.concatenate(upper) if upper else np.zeros(0, np.uint64), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's whole name, its smallest hashes (row << 32 | hash, in order), and their bounds by row."""
    root, name, row = names(data, offsets)
    keys = np.unique(row.astype(np.uint64) << np.uint64(32) | name >> np.uint64(32))
    n = len(offsets) - 1
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    rank = np.arange(len(keys)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys = keys[rank < SKETCH]
    return root, keys, np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def written(root: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Fingerprints as text: the whole name, a colon, and the smallest hashes, in hexadecimal digits."""
    low = keys.astype(np.uint32).astype(">u4").tobytes().hex()
    return [f"{int(r):016x}:{low[8 * a : 8 * b]}" for r, a, b in zip(root, bounds[:-1], bounds[1:], strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, the share of common names among the smallest of both; 1 for equal whole names."""
    n = len(a[0])
    both = np.sort(np.concatenate([a[1], b[1]]))
    twice = np.zeros(len(both), bool)
    twice[:-1] = both[1:] == both[:-1]
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    keys, twice = both[first], twice[first]
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    rank = np.arange(len(keys)) - np.repeat(bounds[:-1], np.diff(bounds))
    row = (keys >> np.uint64(32)).astype(np.int64)
    counts = rank < SKETCH
    common = np.bincount(row[counts & twice], minlength=n)
    total = np.minimum(np.diff(bounds), SKETCH)
    out = np.where(a[0] == b[0], 1.0, common / np.maximum(1, total))
    return np.where((a[0] == 0) != (b[0] == 0), 0.0, out)


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """`doc_id`, `text`, `next_text` (of the next row by descending id, after the last of the first), `part` and `copy`,
    in that order within `part`.

    Ids are cut into ranges at sampled splitters; the first row of each range goes to the end of the range before it as well
    (`copy`), so each range finds its rows' neighbours alone. What comes to the driver is one id for each range.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = sorted(set(rows.select("key").approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c > F.col("key")))
    rows = rows.withColumn("part", part)
    heads = [(r.part, r.key) for r in rows.groupBy("part").agg(F.max("key").alias("key")).orderBy("part").collect()]
    if not heads:
        return rows.select("doc_id", "text", F.lit("").alias("next_text"), "part", F.lit(False).alias("copy"))
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}
    spark = documents.sparkSession
    extra = F.broadcast(spark.createDataFrame(list(before.items()), "key long, to long"))  # one row a range
    rows = rows.join(extra, "key", "left")
    own = F.struct(F.col("part").cast("long").alias("part"), F.lit(False).alias("copy"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("part"), F.lit(True).alias("copy"))))))
    rows = rows.select("doc_id", "text", "key", "place.part", "place.copy")
    rows = rows.repartitionByRange(len(heads), "part")  # a range to a task, where dealing by hash would give one task several
    order = Window.partitionBy("part").orderBy("copy", F.desc("key"), F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(order)).select("doc_id", "text", "next_text", "part", "copy")


def compare_edited(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of the text edited with the next row's beginning, and both likenesses.

    Returns `doc_id`, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next`.
    """
    if not ranges:
        total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    rows = with_next(documents, ranges)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.coalesce(F.col("next_text").substr(F.lit(1), third), F.lit("")))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "copy")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "copy")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row waits for the one after it
        for batch in batches:
            for part in tx.slices(batch, "text"):
                column = {f.name: part.column(i) for i, f in enumerate(part.schema)}
                own, other = sketches(*tx.utf8(column["text"])), sketches(*tx.utf8(column["edited"]))
                prints = written(*own)
                near = likeness(own, other)
                rows = pa.table({c: column[c] for c in ("doc_id", "n_chars", "edited_sha256")} | {"fingerprint": prints, "edited_fingerprint": written(*other), "near_edited": near, "copy": column["copy"]})
                if held is not None:
                    rows = pa.concat_tables([held[0], rows])
                    own = _joined(held[1], own)
                held = rows.slice(rows.num_rows - 1), _one(own, len(own[0]) - 1)
                yield from _out(rows.slice(0, rows.num_rows - 1), likeness(_rows(own, 0, len(own[0]) - 1), _rows(own, 1, len(own[0]))))
        if held is not None:
            yield from _out(held[0], np.ones(1))

    return rows.mapInArrow(run, schema)


Sketches = tuple[np.ndarray, np.ndarray, np.ndarray]


def _rows(s: Sketches, a: int, b: int) -> Sketches:
    """Rows a to b - 1, counted from 0 again."""
    root, keys, bounds = s
    return root[a:b], keys[bounds[a] : bounds[b]] - (np.uint64(a) << np.uint64(32)), bounds[a : b + 1] - bounds[a]


def _one(s: Sketches, i: int) -> Sketches:
    return tuple(x.copy() for x in _rows(s, i, i + 1))


def _joined(a: Sketches, b: Sketches) -> Sketches:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + (np.uint64(len(a[0])) << np.uint64(32))]), np.concatenate([a[2], b[2][1:] + a[2][-1]])


def _out(rows: pa.Table, near_next: np.ndarray) -> Iterator[pa.RecordBatch]:
    own = pa.array(~np.array(rows["copy"], bool))
    table = rows.drop_columns(["copy"]).append_column("near_next", pa.array(near_next, pa.float64())).filter(own)
    yield from table.combine_chunks().to_batches()
