"""Benchmark decontamination by generalised suffix automata.

The words of all test items make one automaton: its states are the classes of item passages that end at the same places, and the
transitions lead on by a word. A document's words stream through it; after each word the state and the length of the longest
passage that ends there are known, which is the longest match. A match of `least` words or more, or of a whole shorter item, is a hit:
its span is removed, and a document goes as a whole where hits cover more than a share of it.

Items are cut into segments that share `least` - 1 words, and segments are dealt into blocks of a bounded number of words; each
block's automaton is built in a task, and broadcast after its size has been checked. Documents are scanned once: a sieve of the hashed
word triples of all items (shorter ones, if an item has fewer words), 16 MB at most, tells in which stretches a match could reach the needed
length. These alone stream through the automata, with one block at once, with several block after block; elsewhere no item has
these words together. Beyond some fifty million words of items the sieve lets more through, and results stay the same.

Defined results: a null text has no words and no hits, and stays null; a null or wordless item has no windows; a null item id is listed as an empty
one; equal ids count once; repeated rows get the same result each; an empty benchmark leaves all as it is; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from . import text as tx

#: Words of a match from which its span is a hit.
LEAST = 10
#: Share of a document's words in hits above which the whole document goes.
MOST_COVERED = 0.5
#: Words of the segments in one automaton on average, of one segment, and bytes of a pickled automaton at most.
BLOCK_WORDS, SEGMENT_WORDS, BLOCK_BYTES = 100_000, 5_000, 64 << 20
#: Binary logarithm of the sieve's bits at most.
SIEVE_BITS = 27

SPAN = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])


class Automaton:
    """A generalised suffix automaton over words, with the items that its long passages and its short items belong to."""

    def __init__(self, least: int = LEAST) -> None:
        self.least = least
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[tuple[int, int, int]] = []  # state, length, item: of each window
        self.items: list[str] = []

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extended(self, last: int, w: int) -> int:
        """The state of `last`'s longest passage and one more word."""
        if w in self.next[last]:  # an item before has it
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """The passages of q that are no longer than p's with the word get a state of their own."""
        own = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = own
            p = self.link[p]
        return own

    def add(self, item: str, words: list[bytes], whole: bool) -> None:
        """An item, or a segment of one (not `whole`)."""
        number, last = len(self.items), 0
        self.items.append(item)
        ids = [self.word.setdefault(w, len(self.word)) for w in words]
        for w in ids:
            last = self._extended(last, w)
        if len(ids) < self.least and whole:
            self.ends.append((number, len(ids), tuple(ids)))
        elif len(ids) >= self.least:
            self.ends += [(number, self.least, tuple(ids[i : i + self.least])) for i in range(len(ids) - self.least + 1)]

    def finish(self) -> None:
        """Windows find their states, when no state is split any more."""
        self.windows: dict[tuple[int, int], set[int]] = {}
        for number, n, ids in self.ends:
            at = 0
            for w in ids:
                at = self.next[at][w]
            self.windows.setdefault((at, n), set()).add(number)
        # states hold the windows that their own passages or shorter ones end with
        by_state: dict[int, list[int]] = {}
        for state, n in self.windows:
            by_state.setdefault(state, []).append(n)
        self.own = {s: sorted(n) for s, n in by_state.items()}
        # the next state along the links that has windows, 0 for none
        self.up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.up[s] = self.link[s] if self.link[s] in self.own else self.up[self.link[s]]
        self.ends = []

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """After each word: the state, the longest match that ends there, and the windows (state, words) that end there."""
        state = length = 0
        for word in words:
            w = self.word.get(word, -1)
            while state > 0 and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                state = length = 0
            found, s = [], state
            while s > 0:  # the matched passage is of `state`; shorter ones are along the links
                found += [(s, n) for n in self.own.get(s, ()) if n <= length]
                s = self.up[s]
            yield state, length, found


def gram(words: list[np.ndarray]) -> np.ndarray:
    """A hash of the words whose hashes stand at the same place of each array."""
    out = words[0]
    for own in words[1:]:
        out = out * np.uint64(tx.OTHER) + own
    return out * np.uint64(tx.BASE)


@dataclass
class Sieve:
    """Which hashes of `g` words may be an item's: bits by their leading `bits` bits. `shortest` is the fewest words of a window."""

    g: int
    shortest: int
    bits: int
    table: bytes

    def marks(self, hashes: np.ndarray) -> np.ndarray:
        """For each word whether the words from there on may be an item's."""
        n = len(hashes) - self.g + 1
        at = gram([hashes[k : n + k] for k in range(self.g)]) >> np.uint64(64 - self.bits)
        table = np.frombuffer(self.table, np.uint8)
        return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve_of(cut: DataFrame, g: int, shortest: int, words: int) -> Sieve:
    """The sieve of all segments, 64 places for each word and 2**SIEVE_BITS at most; its pages of bits come to the driver."""
    bits = min(SIEVE_BITS, max(16, (64 * words).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0).to_pylist():
                data = np.frombuffer(b" ".join(words), np.uint8)
                hashes = pieces.hashed_words(data, np.array([0, len(data)]), pieces.ALPHANUMERIC)[2]
                n = len(hashes) - g + 1
                at = np.unique(gram([hashes[k : n + k] for k in range(g)]) >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["place"])

    page = 1 << 15  # bits in one map of bitmap_construct_agg
    places = cut.select("words").mapInArrow(run, "place long")
    pages = places.groupBy(F.floor(F.col("place") / page).alias("page")).agg(F.bitmap_construct_agg(F.col("place") % page).alias("bits"))
    table = bytearray(max(1 << bits, page) // 8)
    for row in pages.collect():  # 4096 pages of 4 KB at most
        table[row.page * page // 8 : (row.page + 1) * page // 8] = row.bits
    return Sieve(g, shortest, bits, bytes(table))


def _words(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _, _ = pieces.hashed_words(data, np.array([0, len(data)]), pieces.ALPHANUMERIC, True)
    whole = tx.lower_ascii(data).tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def segments(benchmark: DataFrame, least: int = LEAST, size: int = SEGMENT_WORDS) -> DataFrame:
    """`item`, `words`, `whole`: the items' words, those of long items in pieces that share `least` - 1 words. Nulls and items without words go."""
    schema = pa.schema([("item", pa.string()), ("words", pa.list_(pa.binary())), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(text)
                rows = [(item, words[i : i + size + least - 1], len(words) <= size + least - 1) for i in range(0, max(1, len(words) - least + 1), size)] if words else []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    rows = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(run, "item string, words array<binary>, whole boolean")


def automata(cut: DataFrame, blocks: int, least: int = LEAST) -> DataFrame:
    """`block`, `n_bytes`, `automaton` (pickled): one row for each block of segments."""
    schema = pa.schema([("block", pa.int32()), ("n_bytes", pa.int64()), ("automaton", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        made = Automaton(least)
        for item, words, whole in sorted(zip(*(table[c].to_pylist() for c in ("item", "words", "whole")), strict=True)):
            made.add(item, words, whole)
        made.finish()
        data = pickle.dumps(made)
        return pa.Table.from_pylist([{"block": table["block"][0].as_py(), "n_bytes": len(data), "automaton": data}], schema=schema)

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, "block int, n_bytes long, automaton binary")


_loaded: dict[int, Automaton] = {}


def _load(data: bytes) -> Automaton:
    """A worker holds one automaton."""
    if hash(data) not in _loaded:
        _loaded.clear()
        _loaded[hash(data)] = pickle.loads(data)
    return _loaded[hash(data)]


def stretches(hashes: np.ndarray, bounds: np.ndarray, sieve: Sieve) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 words of the stretches of rows in which all words together may be an item's and a window has room."""
    if len(hashes) < sieve.shortest:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = sieve.marks(hashes)
    for k in range(1, sieve.g):  # what reaches into the next row
        cut = bounds[1:-1] - k
        mark[cut[(cut >= 0) & (cut < len(mark))]] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    first, last = _cut(edge[::2], edge[1::2], bounds)
    room = last - first + sieve.g - 1 >= sieve.shortest
    return first[room], last[room] + sieve.g - 1


def _cut(first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of grams, cut at the rows' bounds, where those of one word meet."""
    inner = np.unique(bounds[1:-1])
    row_first, row_last = np.searchsorted(inner, first, "right"), np.searchsorted(inner, last - 1, "right")
    crossing = row_first != row_last
    if not crossing.any():
        return first, last
    points = [inner[a:b] for a, b in zip(row_first[crossing], row_last[crossing], strict=True)]
    cuts = np.concatenate(points)
    return np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))


#: A row's stretches: the number of the first word, and the words.
Stretches = list[tuple[int, list[bytes]]]


def _scanned(column: pa.Array, sieve: Sieve | None) -> tuple[np.ndarray, dict[int, Stretches]]:
    """Words of each row, and the stretches of rows that have any."""
    data, offsets = tx.utf8(column)
    starts, ends, hashes, bounds = pieces.hashed_words(data, offsets, pieces.ALPHANUMERIC, True)
    found: dict[int, Stretches] = {}
    for a, b in zip(*(x.tolist() for x in stretches(hashes, bounds, sieve)), strict=True) if sieve else ():
        row = int(np.searchsorted(bounds, a, "right")) - 1
        words, first = tx.lower_ascii(data[starts[a] : ends[b - 1]]).tobytes(), int(starts[a])
        own = [words[s - first : e - first] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        found.setdefault(row, []).append((a - int(bounds[row]), own))
    return np.diff(bounds), found


class Hits:
    """What automata have found in the rows of a batch."""

    def __init__(self, longest: np.ndarray, spans: dict[int, list[tuple[int, int]]], items: dict[int, set[str]]) -> None:
        self.longest, self.spans, self.items = longest, spans, items

    def stream(self, made: Automaton, rows: dict[int, Stretches]) -> None:
        for row, some in rows.items():
            for first, words in some:
                for i, (_, length, found) in enumerate(made.stream(words), first + 1):
                    self.longest[row] = max(self.longest[row], length)
                    for key in found:
                        self.items.setdefault(row, set()).update(made.items[k] for k in made.windows[key])
                    if found:
                        self.spans.setdefault(row, []).append((i - max(n for _, n in found), i))

    def columns(self) -> dict[str, object]:
        n = len(self.longest)
        return {"longest": self.longest, "spans": [[{"first_word": a, "last_word": b - 1} for a, b in merged(self.spans[i])] if i in self.spans else [] for i in range(n)], "items": [sorted(self.items.get(i, ())) for i in range(n)]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or adjoining spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
STRETCHES = T.StructField("stretches", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.BinaryType())])))


def match(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of `keep` of every row with `n_words`, `longest` (words of the longest match with an item within a stretch that could
    hold a window, else 0), `spans` (hits, by word numbers from 0) and `items` (ids of the items hit). These take the place of kept columns
    of the same name."""
    cut = tx.stored(segments(benchmark, least, max(1, min(SEGMENT_WORDS, block_words // 4))))
    total, shortest = cut.agg(F.sum(F.size("words")), F.min(F.size("words"))).first()
    keep = tuple(c for c in dict.fromkeys(keep) if c not in {f.name for f in FIELDS})
    if not total:
        return tx.map_text(documents, "text", lambda part: _found(*_scanned(part.column(part.schema.get_field_index("text")), None), []), FIELDS, keep)
    shortest = min(least, shortest)
    sieve = sieve_of(cut, min(3, shortest), shortest, total)
    blocks = tx.stored(automata(cut, max(1, -(-total // block_words)), least))
    sizes = [(r.block, r.n_bytes) for r in blocks.select("block", "n_bytes").orderBy("block").collect()]  # two numbers a block
    if large := [b for b in sizes if b[1] > BLOCK_BYTES]:
        raise ValueError(f"automata above {BLOCK_BYTES} bytes: {large}; lower block_words")
    automaton = lambda block: bytes(blocks.where(F.col("block") == block).first().automaton)
    if len(sizes) == 1:
        data = automaton(sizes[0][0])
        return tx.map_text(documents, "text", lambda part: _found(*_scanned(part.column(part.schema.get_field_index("text")), sieve), [_load(data)]), FIELDS, keep)

    def scan(part: pa.RecordBatch) -> dict[str, object]:
        n_words, rows = _scanned(part.column(part.schema.get_field_index("text")), sieve)
        return _found(n_words, {}, []) | {_OPEN: [[{"first": a, "words": b" ".join(w)} for a, w in rows.get(i, ())] for i in range(len(n_words))]}

    _OPEN = "stretches" if "stretches" not in keep else "stretches_of_" + "_".join(keep)
    open_field = T.StructField(_OPEN, STRETCHES.dataType)
    rows = tx.stored(tx.map_text(documents, "text", scan, [*FIELDS, open_field], keep))
    out = rows.where(F.size(_OPEN) == 0).select(*keep, *[f.name for f in FIELDS])
    rows = rows.where(F.size(_OPEN) > 0)  # these alone go on from block to block
    for block, _ in sizes:

        def work(batches: Iterator[pa.RecordBatch], data: bytes = automaton(block), names: list[str] = rows.columns) -> Iterator[pa.RecordBatch]:
            made = _load(data)
            for batch in batches:
                column = dict(zip(names, batch.columns, strict=True))
                spans = {i: [(s["first_word"], s["last_word"] + 1) for s in v] for i, v in enumerate(column["spans"].to_pylist()) if v}
                hits = Hits(column["longest"].to_numpy(zero_copy_only=False).copy(), spans, {i: set(v) for i, v in enumerate(column["items"].to_pylist()) if v})
                hits.stream(made, {i: [(x["first"], x["words"].split(b" ")) for x in v] for i, v in enumerate(column[_OPEN].to_pylist())})
                new = hits.columns()
                yield pa.RecordBatch.from_arrays([pa.array(new[n], column[n].type) if n in new else column[n] for n in names], names=names)

        rows = tx.stored(rows.mapInArrow(work, rows.schema))
    return out.unionByName(rows.select(*out.columns))


def _found(n_words: np.ndarray, rows: dict[int, Stretches], made: list[Automaton]) -> dict[str, object]:
    hits = Hits(np.zeros(len(n_words), np.int64), {}, {})
    for own in made:
        hits.stream(own, rows)
    return {"n_words": n_words} | hits.columns()


def _hit() -> Column:
    """Words in hits."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last_word"] - s["first_word"] + 1)


def decontaminate(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, most_covered: float = MOST_COVERED) -> DataFrame:
    """What `match` finds, with `coverage` (share of the words in hits), `dropped` (above `most_covered`) and `kept`: the text without the hits'
    bytes, from the first word's first to the last word's last; empty where the document is dropped, null for a null text."""
    found = match(documents, benchmark, tuple(dict.fromkeys([*keep, "text"])), least)
    found = found.withColumn("coverage", F.when(F.col("n_words") > 0, _hit() / F.col("n_words")).otherwise(F.lit(0.0)))
    found = found.withColumn("dropped", F.col("coverage") > most_covered)

    def work(part: pa.RecordBatch) -> dict[str, object]:
        column = {f.name: part.column(i) for i, f in enumerate(part.schema)}
        out = []
        for text, spans, dropped in zip(column["text"].to_pylist(), column["spans"].to_pylist(), column["dropped"].to_pylist(), strict=True):
            if text is None or dropped or not spans:
                out.append("" if dropped and text is not None else text)
                continue
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _, _ = pieces.hashed_words(data, np.array([0, len(data)]), pieces.ALPHANUMERIC, True)
            stay = np.ones(len(data), bool)
            for s in spans:
                stay[starts[s["first_word"]] : ends[s["last_word"]]] = False
            out.append(data[stay].tobytes().decode())
        return {"kept": pa.array(out, pa.string())}

    columns = [*keep, "n_words", "longest", "spans", "items", "coverage", "dropped"]
    return tx.map_text(found, "text", work, [T.StructField("kept", T.StringType())], columns)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id`, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated` of every row."""
    found = match(documents, benchmark, ("doc_id",))
    return found.select("doc_id", "n_words", _hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_LIST = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_LIST} AS words FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, least({LEAST}, len(words)) AS k, array_to_string(list_slice(words, i, i + least({LEAST}, len(words)) - 1), ' ') AS w FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - {LEAST - 1}) + 1)) AS i FROM item WHERE len(words) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_LIST}, []) AS words FROM documents),
kinds AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT r, i, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS w FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM doc, kinds)),
found AS (SELECT g.r, g.i, g.k, w.item FROM grams g JOIN windows w ON w.k = g.k AND w.w = g.w),
places AS (SELECT r, count(DISTINCT word_no) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS word_no FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.listed, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM doc d LEFT JOIN places p ON p.r = d.r LEFT JOIN items t ON t.r = d.r
"""
