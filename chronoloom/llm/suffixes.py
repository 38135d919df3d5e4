"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts elsewhere as well.

Sorting every suffix of a corpus means one row for each byte. Whether a string of `length` bytes repeats is decided by far fewer
suffixes: in each such string, the anchor, the run of `LEAD` bytes with the smallest hash, depends on the string alone, so equal
strings have the same anchor at the same place. Consecutive starts with one anchor form a piece. Then:

1. pieces whose anchor bytes occur once can't repeat; a hash aggregate with partial sums finds the others;
2. pieces whose whole bytes occur again repeat as a whole, and one copy of each goes on;
3. the suffixes at the anchors are range-partitioned by their leading bytes at sampled splitters, each bucket sorts its suffixes by
   multikey quicksort, and within runs of equal leading bytes the strings at all starts are compared. Splitters are values of
   the leading bytes, so a run lies in one bucket.
4. A run of more than `HOT` suffixes is first cut by more leading bytes: starts at most `NARROW` apart share all but so many of
   their strings' bytes, which become the leading bytes, and most suffixes have them alone. What is still more than `HOT` is
   cut into single starts, whose leading bytes are their whole strings: there an equal one is a repeat, and nothing is compared.

Defined results: a null text is empty; matches never cross rows, and equal rows are copies of one another; strings are judged
on the input; an empty table gives no rows; extra columns are ignored. Leading bytes are compared as they are in step 3, other bytes
by 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

LENGTH = 400
#: Bytes of an anchor: eight tokens of eight bytes.
LEAD = 64
TOKEN = 8
#: Places in a slice, above the bytes of any text, which an array of Spark holds.
PLACES = 1 << 31
#: Bytes of a text that are cut into pieces at a time.
LONG_TEXT = 4 << 20
#: Suffixes with equal leading bytes that one bucket compares, about 5 MB of them; more of them are cut by more leading bytes.
HOT = 8192
#: Starts that share leading bytes then.
NARROW = 42
#: Frequent keys that a broadcast may hold, a few megabytes.
MOST_HOT = 100_000


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first start, last start and anchor of each piece, and the hashes of anchor and whole piece."""
    n = len(data)
    span = length - LEAD + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if n < length:
        return empty
    prefix = tx.prefix_hash(data)
    at = np.arange(n - LEAD + 1)
    lead = tx.span_hash(prefix, at, at + LEAD)
    # the smallest hash in front, the place behind: of equal hashes the first place wins, in equal strings the same one
    low, width = lead & ~np.uint64(PLACES - 1) | at.astype(np.uint64), 1
    while width < span:  # minima of ever wider windows
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    # starts of strings within one row
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(0, np.diff(offsets) - length + 1))
    if not len(row):
        return empty
    first_of_row = np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(offsets) - length + 1))])[:-1]
    start = offsets[row] + np.arange(len(row)) - first_of_row[row]
    anchor = (low[start] & np.uint64(PLACES - 1)).astype(np.int64)
    cut = np.ones(len(row), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(cut)
    last = np.append(head[1:], len(row)) - 1
    a, b, anchor, row = start[head], start[last], anchor[head], row[head]
    return row, a - offsets[row], b - offsets[row], anchor - a, lead[anchor], tx.span_hash(prefix, a, b + length)


def pieces(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of each row: `row` (128 bits of id and text), first and last start, place of the anchor from the first
    start, hashes of anchor and piece. A long text is cut into parts that overlap by a string less a byte."""

    def cut(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = tx.utf8(part.column(1))
        step = max(LONG_TEXT, len(data)) if part.num_rows > 1 else LONG_TEXT
        for lo in range(0, max(1, len(data) - length + 1), step):
            row, a, b, anchor, lead, whole = _anchors(data[lo : lo + step + length - 1], np.minimum(np.maximum(offsets - lo, 0), step + length - 1) if len(data) else offsets, length)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array((a + lo).astype(np.int32)), pa.array((b + lo).astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(lead.view(np.int64)), pa.array(whole.view(np.int64))],
                names=["row", "a", "b", "anchor", "lead", "whole"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                yield from cut(part)

    rows = documents.select(tx.row_key(F.col("doc_id"), F.col("text")).alias("row"), "text").where(F.octet_length("text") >= length)
    return tx.map_arrow(rows, run, "row binary, a int, b int, anchor int, lead long, whole long")


def multikey_sort(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows of tokens, and the number of each row's run of equal rows in that order.

    Multikey quicksort, a token at a time: only rows that are equal so far are sorted by the next token.
    """
    n = len(tokens)
    order = np.arange(n)
    run = np.zeros(n, np.int64)
    for k in range(tokens.shape[1]):
        open_ = np.zeros(n, bool)
        if n > 1:
            same = run[1:] == run[:-1]
            open_[1:] |= same
            open_[:-1] |= same
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = order[at]
        by = np.lexsort((tokens[own, k], run[at]))
        order[at] = own[by]
        differs = np.ones(n, bool)
        differs[1:] = (run[1:] != run[:-1]) | (tokens[order[1:], k] != tokens[order[:-1], k])
        run = np.cumsum(differs) - 1
    return order, run


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all starts of pieces: the piece, the start in its row, and two hashes of the string there."""
    data, offsets = tx.utf8(_column(batch, "bytes"))
    n = np.diff(offsets) - length + 1
    piece = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[piece] + inside
    one, other = (tx.span_hash(tx.prefix_hash(data, base), at, at + length, base) for base in (tx.BASE, tx.OTHER))
    return piece, _numbers(batch, "a")[piece] + inside, one, other


def _ranges(row: pa.Array, piece: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Consecutive starts of a piece as one range."""
    cut = np.ones(len(piece), bool)
    cut[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(cut)
    last = np.append(head[1:], len(piece)) - 1 if len(piece) else head
    return pa.RecordBatch.from_arrays([row.take(pa.array(piece[head])), pa.array(start[head].astype(np.int32)), pa.array(start[last].astype(np.int32))], names=["row", "a", "b"])


RANGES = "row binary, a int, b int"


def _compare_sorted(suffixes: DataFrame, length: int) -> DataFrame:
    """Ranges of starts whose strings stand in another suffix of the same run of leading bytes, which are all of one length."""

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        lead = _column(rows, "lead_bytes").to_pylist()
        width = -(-len(lead[0]) // TOKEN)
        tokens = np.frombuffer(b"".join(x.ljust(width * TOKEN, b"\0") for x in lead), ">u8").reshape(-1, width)
        order, run = multikey_sort(tokens.astype(np.uint64))
        rows = rows.take(pa.array(order))
        piece, start, value, check = _starts(rows, length)
        by = np.lexsort((check, value, run[piece]))
        r, v, c = run[piece][by], value[by], check[by]
        same = np.zeros(len(by), bool)
        same[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1]) & (c[1:] == c[:-1])
        twice = same.copy()
        twice[:-1] |= same[1:]
        hit = np.zeros(len(by), bool)
        hit[by] = twice
        hit &= _numbers(rows, "copies")[piece] == 1  # pieces with copies are covered anyway
        return _ranges(_column(rows, "row"), piece[hit], start[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in tx.slices(batch, "bytes"):
                held.append(part)
                size += part.nbytes
                if size < 4 * tx.SLICE_BYTES:
                    continue
                # suffixes come in order of their leading bytes: all but the last run can be compared
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                lead = _column(rows, "lead_bytes")
                final, end = lead[rows.num_rows - 1], rows.num_rows - 1
                while end and lead[end - 1] == final:
                    end -= 1
                if end:
                    yield compare(rows.slice(0, end))
                held = [rows.slice(end)]
                size = held[0].nbytes
        if held and sum(x.num_rows for x in held):
            yield compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = suffixes.select("row", "a", "copies", "bytes", "lead_bytes")
    return tx.map_arrow(rows.repartitionByRange(parts, "lead_bytes").sortWithinPartitions("lead_bytes"), run, RANGES)


def _join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """`rows` joined with `groups`, a stored table of one row for each key, without a shuffle of the rows of frequent keys.

    Keys of more than `HOT` rows, in the groups' column `n`, meet their rows by a broadcast, the others by a shuffle. If more than
    `MOST_HOT` keys are frequent, all are joined by a shuffle, whose large partitions adaptive execution splits.
    """
    hot, cold = groups.where(F.col(n) > HOT), groups.where(F.col(n) <= HOT)
    if hot.limit(MOST_HOT + 1).count() > MOST_HOT:
        return rows.join(groups, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def _narrowed(suffixes: DataFrame, length: int, width: int) -> DataFrame:
    """Suffixes cut into classes of `width` starts by the distance to their anchor, `at` in their bytes.

    All strings of a class share `length - width + 1` bytes, which are its leading bytes: `core` and `core2` are their hashes. Classes
    of one start leave the bytes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "bytes", tx.SLICE_BYTES // max(1, 8 // width)):
                data, offsets = tx.utf8(_column(part, "bytes"))
                at, n = _numbers(part, "at"), np.diff(offsets) - length + 1
                first, last = (at - n + 1) // width, at // width  # classes of the last and the first start
                k = last - first + 1
                piece = np.repeat(np.arange(len(k)), k)
                kind = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(k) - k, k)
                lo = np.maximum(0, at[piece] - (kind + 1) * width + 1)
                hi = np.minimum(n[piece] - 1, at[piece] - kind * width)
                core = at[piece] - kind * width
                begin, end = offsets[piece] + core, offsets[piece] + core + length - width + 1
                hashes = [tx.span_hash(tx.prefix_hash(data, base), begin, end, base).view(np.int64) for base in (tx.BASE, tx.OTHER)]
                size = hi - lo + length
                whole = np.ascontiguousarray(data).tobytes()
                own = [whole[x : x + y] for x, y in zip((offsets[piece] + lo).tolist(), size.tolist(), strict=True)] if width > 1 else [b""] * len(piece)
                yield pa.RecordBatch.from_arrays(
                    [_column(part, "row").take(pa.array(piece)), pa.array((_numbers(part, "a")[piece] + lo).astype(np.int32)), pa.array(_numbers(part, "copies")[piece]), pa.array((core - lo).astype(np.int32)), pa.array(own, pa.binary()), *map(pa.array, hashes)],
                    names=["row", "a", "copies", "at", "bytes", "core", "core2"],
                )

    return tx.map_arrow(suffixes.select("row", "a", "copies", "at", "bytes"), run, "row binary, a int, copies long, at int, bytes binary, core long, core2 long")


def _compare_frequent(suffixes: DataFrame, length: int) -> DataFrame:
    """The same as `_compare_sorted` for runs of very many suffixes, cut by more leading bytes until few have them."""
    key = ["core", "core2"]
    cut = tx.stored(_narrowed(suffixes, length, NARROW))
    groups = tx.stored(cut.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    open_ = tx.stored(_join_hot(cut, groups, key, "n"))
    few = open_.where(F.col("n") <= HOT).withColumn("lead_bytes", F.substring("bytes", F.col("at") + 1, F.lit(length - NARROW + 1)))
    single = _narrowed(open_.where(F.col("n") > HOT), length, 1)
    again = tx.stored(single.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    hits = _join_hot(single.where("copies = 1"), again, key, "n")
    return _compare_sorted(few, length).unionByName(hits.select("row", "a", F.col("a").alias("b")))


def repeated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each row key with repeated strings: `row` and `spans`, the maximal runs of covered bytes (from, to), in order."""
    found = tx.stored(pieces(documents, length))
    groups = found.groupBy("lead").agg(F.count("*").alias("n"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("n > 1")
    groups = tx.stored(groups)
    shared = tx.stored(_join_hot(tx.sieved(found, groups, "lead").where("sieved").drop("sieved"), groups, ["lead"], "n"))
    alike = shared.where("w0 = w1").select("row", "a", "b")
    mixed = shared.where("w0 != w1")
    kinds = tx.stored(mixed.groupBy("lead", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("row", "a", "b", "anchor")).alias("one"), F.first("n").alias("n")))
    copied = _join_hot(mixed, kinds.where("copies > 1").select("lead", "whole", "copies"), ["lead", "whole"], "copies").select("row", "a", "b")
    one = tx.stored(kinds.select("one.*", "copies", "n"))
    texts = documents.select(tx.row_key(F.col("doc_id"), F.col("text")).alias("row"), F.encode("text", "utf-8").alias("all")).where(F.octet_length("all") >= length)
    texts = tx.sieved(texts, one.select("row").distinct(), "row").where("sieved").select("row", "all")
    suffixes = one.join(texts, "row").select("row", "a", "copies", "n", F.col("anchor").alias("at"), F.substring("all", F.col("a") + 1, F.col("b") - F.col("a") + length).alias("bytes"), F.substring("all", F.col("a") + F.col("anchor") + 1, F.lit(LEAD)).alias("lead_bytes"))
    suffixes = tx.stored(suffixes)
    ranges = alike.union(copied).union(_compare_sorted(suffixes.where(F.col("n") <= HOT), length))
    frequent = suffixes.where(F.col("n") > HOT)
    if frequent.head(1):
        ranges = ranges.union(_compare_frequent(frequent, length))
    spans = ranges.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # bounded by the row's bytes

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            a, b = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            wide = np.int64(1) << np.int64(40)
            order = np.argsort(row * wide + a, kind="stable")
            row, a, end = row[order], a[order], (b + length)[order]
            far = np.maximum.accumulate(row * wide + end)
            cut = np.ones(len(row), bool)
            cut[1:] = (row[1:] * wide + a[1:]) > far[:-1]
            head = np.flatnonzero(cut)
            last = np.append(head[1:], len(row)) - 1
            bounds = np.searchsorted(row[head], np.arange(batch.num_rows + 1))
            values = pa.StructArray.from_arrays([pa.array(a[head].astype(np.int32)), pa.array((far[last] - row[last] * wide).astype(np.int32))], names=["from", "to"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)], names=["row", "spans"])

    return tx.map_arrow(spans, merge, "row binary, spans array<struct<from:int,to:int>>")


def kept_bytes(all_bytes: Column, spans: Column) -> Column:
    """The bytes outside the spans, one after the other."""
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["to"])),
        F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.octet_length(all_bytes))),
        lambda a, b: F.substring(all_bytes, a + 1, b - a),
    )
    return F.unhex(F.array_join(F.transform(gaps, F.hex), ""))


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of `documents` in the struct `document`, with `n_bytes`, `spans` (null: none) and `kept` (binary).

    Only rows that may have spans are shuffled to meet them.
    """
    spans = tx.stored(repeated(documents, length))
    rows = documents.select(tx.row_key(documents["doc_id"], documents["text"]).alias("row"), F.struct(*[documents[c] for c in documents.columns]).alias("document"))
    rows = tx.sieved(rows, spans, "row")
    rows = rows.where("sieved").join(spans, "row", "left").select("document", "spans").union(rows.where("NOT sieved").select("document", F.lit(None).cast(spans.schema["spans"].dataType)))
    own = F.encode(F.coalesce("document.text", F.lit("")), "utf-8")
    kept = F.when(F.col("spans").isNull(), own).otherwise(kept_bytes(own, F.col("spans")))
    return rows.select("document", F.octet_length(own).cast("long").alias("n_bytes"), "spans", kept.alias("kept"))
