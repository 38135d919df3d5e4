"""Helpers that the operators of this subpackage share: Arrow batches as UTF-8 byte arrays, word bounds, rolling hashes.

A batch of documents is one byte array and its document offsets, as Arrow holds it, so that words, n-grams and windows of
all documents of a slice are found by a few array operations. Slices keep a task's memory independent of the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.storage import removed, shared_folder, stored  # noqa: F401

#: Bytes of text that one step works on at a time.
SLICE_BYTES = 500_000
#: Odd multipliers of the rolling hashes modulo 2**64.
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = {b: pow(b, -1, 1 << 64) for b in (BASE, OTHER)}
#: Binary logarithm of the bits of a sieve at most.
SIEVE_BITS = 27
#: The separators of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. Those that a slice needs are kept, longer ones are made again."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and the n + 1 offsets of its rows; a null is empty."""
    binary = column.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = binary.buffers()
    if len(binary) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes in `column`, one row at least."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def returned_memory() -> None:
    """Gives memory that Arrow and numpy have freed but keep back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`df.mapInArrow(run, schema)`, each task of which gives its memory back at its end.

    A worker runs the tasks of all operators one after the other, and would hold what the largest of them needed through the rest.
    """
    return df.mapInArrow(lambda batches: returning(run(batches)), schema)


def returning(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from made
    finally:
        del made
        returned_memory()


def map_text(
    df: DataFrame,
    text: str,
    work: Callable[[pa.RecordBatch], dict[str, object]],
    fields: list[T.StructField],
    keep: Iterable[str] = (),
    most: int = SLICE_BYTES,
) -> DataFrame:
    """`df` with the columns of `keep`, and those of `fields` that `work` makes for each slice of its rows (of about `most` bytes), row by row.

    A made column takes the place of a kept one of the same name.
    """
    made = [f.name for f in fields]
    kept = [c for c in dict.fromkeys(keep) if c not in made]
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                new = work(part)
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                arrays += [x if isinstance(x := new[n], pa.Array) else pa.array(x, k) for n, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *made])

    schema = T.StructType([df.schema[c] for c in kept] + fields)
    return map_arrow(df.select(*dict.fromkeys([*kept, text])), run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}[kind.typeName()]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in the table `inside`, and the bounds of each row's words among them."""
    n = len(data)
    mark = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = mark[:-1]
    after = np.zeros(n, bool)
    after[:-1] = mark[1:]
    starts = np.flatnonzero(mark & (~before | edge[:-1]))
    ends = np.flatnonzero(mark & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of (byte + 1) * base**i before each position."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands. Those of two bases make 128 bits."""
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE[base], len(prefix))[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[offsets[1:]] - lead[offsets[:-1]]


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart by their id and text; equal rows share them."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(text.isNull(), ":0").otherwise(":1"), F.coalesce(text, F.lit("")))))


def sieved(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """`rows` with the flag `sieved`: true for all rows whose `column` is among the keys, and for few others.

    Each key sets one bit by its hash, of 32 for each key and of `SIEVE_BITS` at most, so what is broadcast is 16 MB at most, however
    many keys there are; more keys let more other rows pass. What passes still has to be joined to the keys.
    """
    bits = 1 << min(SIEVE_BITS, max(16, (32 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    page = 1 << 15  # bits in one map of bitmap_construct_agg
    maps = keys.select(place.alias("_place")).groupBy(F.floor(F.col("_place") / page).alias("_page")).agg(F.bitmap_construct_agg(F.col("_place") % page).alias("_bits"))
    rows = rows.withColumn("_place", place).withColumn("_page", F.floor(F.col("_place") / page)).join(F.broadcast(maps), "_page", "left")
    at = F.col("_place") % page
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("sieved", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_place", "_page", "_bits")
