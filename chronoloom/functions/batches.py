"""Whole documents in Arrow batches, many at once, and arrays that hold many graphs in compressed sparse rows.

Rows are dealt by document and sorted, so a document's rows stand together; batches are cut and joined between documents. Work is done
on flat arrays of all documents of a batch: there is no loop over documents or edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are worked on together, but for a document with more.
TOGETHER = 1 << 16


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the end."""
    return np.concatenate([np.flatnonzero(np.diff(values, prepend=values[0] - 1)), [len(values)]]) if len(values) else np.zeros(1, np.int64)


def keys(table: pa.Table, by: list[str]) -> np.ndarray:
    """Numbers that change where a key does; keys may be null."""
    change = np.zeros(table.num_rows, np.int64)
    for name in by:
        column = table.column(name).combine_chunks()
        null = column.is_null().to_numpy(zero_copy_only=False)
        value = column.fill_null(0).to_numpy(zero_copy_only=False)
        for own in (null, value):
            change[1:] |= own[1:] != own[:-1]
    return np.cumsum(change)


def whole_documents(rows: DataFrame, work: Callable[[pa.Table], pa.Table | pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str | T.StructType, order: tuple[str, ...] = (), by: tuple[str, ...] = ("doc_id",), together: int = TOGETHER) -> DataFrame:
    """What `work` makes of tables of whole documents (`by`, numbers), whose rows stand together, in the given order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            made = work(table)
            if isinstance(made, pa.RecordBatch):
                yield made
            elif isinstance(made, pa.Table):
                yield from made.to_batches()
            else:
                yield from made

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size >= together:
                table = pa.concat_tables(held)
                cut = int(runs_of(keys(table, list(by)))[-2])  # the last document may go on in the next batch
                if cut:
                    yield from done(table.slice(0, cut))
                held, size = [table.slice(cut)], table.num_rows - cut
        if held:
            yield from done(pa.concat_tables(held))

    # by a struct: a join by the same columns would stand in for this exchange, and where it turns into a broadcast its rows are read as they
    # were written, so a document's rows would be in several tasks
    return rows.repartition(F.struct(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def places(table: pa.Table) -> np.ndarray:
    """The number of each row's document in the table, from 0."""
    return keys(table, ["doc_id"])


def tagged(nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """Events and edges in one table: `doc_id`, `i` (an event, or an edge's source), `j` (null for an event), and the columns `more` of either."""
    own = nodes.select("doc_id", F.col("event_no").alias("i"), F.lit(None).cast("long").alias("j"), *[c for c in more if c in nodes.columns])
    return own.unionByName(edges.select("doc_id", "i", "j", *[c for c in more if c in edges.columns]), allowMissingColumns=True)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


@dataclass
class Graphs:
    """The graphs of many documents: events are numbered through, by document and event number.

    `doc` and `event` are of the numbered events, `bounds` the documents' bounds among them, `local` an event's place in its document;
    `rows` are the places of the events in the table (events that only edges name have none, -1); `src` and `dst` are edges.
    """

    doc: pa.Array
    event: np.ndarray
    bounds: np.ndarray
    local: np.ndarray
    rows: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    edge_rows: np.ndarray

    @property
    def n(self) -> int:
        return len(self.event)

    def ids(self, at: np.ndarray) -> list[pa.Array]:
        """The documents and event numbers of some events."""
        return [self.doc.take(pa.array(at)), pa.array(self.event[at], pa.int64())]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def graph(self) -> np.ndarray:
        """The number of each event's document."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.sizes)


def graphs_of(table: pa.Table) -> Graphs:
    """The graphs in a table of `tagged` rows, sorted by document."""
    doc = keys(table, ["doc_id"])
    i, is_edge = numbers(table, "i"), table.column("j").is_valid().to_numpy()
    j = table.column("j").fill_null(0).to_numpy()
    edge_rows, node_rows = np.flatnonzero(is_edge), np.flatnonzero(~is_edge)
    every_doc = np.concatenate([doc[node_rows], doc[edge_rows], doc[edge_rows]])
    every = np.concatenate([i[node_rows], i[edge_rows], j[edge_rows]])
    order = np.lexsort((every, every_doc))  # stable: an event's own row before edges that name it
    d, e = every_doc[order], every[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    m, n = len(node_rows), len(edge_rows)
    rows = np.full(len(head), -1)
    rows[number[:m][::-1]] = node_rows[::-1]
    doc_of = d[fresh]
    bounds = runs_of(doc_of)
    first = np.concatenate([node_rows, edge_rows, edge_rows])[head]
    return Graphs(table.column("doc_id").combine_chunks().take(pa.array(first)), e[fresh], bounds, np.arange(len(head)) - np.repeat(bounds[:-1], np.diff(bounds)), rows, number[m : m + n], number[m + n :], edge_rows)


def grouped(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of entries by key, and the bounds of each key below `n` in it: compressed sparse rows."""
    order = np.argsort(keys, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def segment_sum(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by key, added in the order of the rows."""
    order, bounds = grouped(keys, n)
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values[order], bounds[some], axis=0)
    return out


def segment_max(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Largest values by key; minus infinity for a key without any."""
    order, bounds = grouped(keys, n)
    out = np.full((n, *values.shape[1:]), -np.inf)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.maximum.reduceat(values[order], bounds[some], axis=0)
    return out
