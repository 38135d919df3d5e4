"""Periodic runs of words, found in the grammars of texts.

A run is a stretch of words that repeats its first q words, its smallest period, four times or more, at least six words in all, and
that neither neighbouring word extends. Re-Pair replaces repeated pairs of neighbouring symbols by nonterminals until no pair is
left twice, in rounds: each round replaces all pairs that are more frequent than those they overlap with. What is left is paired up to
one symbol. A run crosses the boundary between both parts of the smallest nonterminal that holds it, so runs that cross a boundary
are looked for once for each nonterminal, carried to all places where the derivation has it, and merged to the longest ones.

A pair inside a run stands there three times at least. So texts are first cut where a pair of neighbours stands less often, in the
text and then in the stretch, and what is too short for a run goes: no grammar is made of words that no run can hold. All stretches of
a slice of documents are worked on together, as their symbols differ.

Defined results: a null text has no words; words are compared byte by byte; repeated rows get the same result each; an empty table
has no rows; extra columns are ignored. A text's memory is some 50 bytes a word, and in its grammar 150 a word of the stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces
from . import text as tx

#: Words of a run at least, and periods.
LEAST, PERIODS = 6, 4
#: Tests of a possible square that are made at once.
TOGETHER = 1 << 20

#: Bytes of text that one step works on: the grammar's rounds cost the same for few words as for many.
SLICE = 2_000_000

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


# grammar


@dataclass
class Grammar:
    """Nonterminals by number, from `terminals` on: both parts, words, a place where it stands first, and the round that made it."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray  # of terminals too
    first: np.ndarray  # of terminals too
    rounds: list[int]  # the first nonterminal of each round
    symbols: np.ndarray  # that derive the whole, and their places
    places: np.ndarray


def _alternate(chosen: np.ndarray) -> np.ndarray:
    """Every second mark of each stretch of marks, from its first on."""
    at = np.flatnonzero(chosen)
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.diff(at) > 1
    head = np.maximum.accumulate(np.where(fresh, at, 0))
    return at[(at - head) % 2 == 0]


def grammar(ids: np.ndarray, stretch: np.ndarray) -> Grammar:
    """Re-Pair of `ids`, whose stretches (numbered in `stretch`) share no symbol, then pairs until each stretch is one symbol."""
    terminals = int(ids.max()) + 1 if len(ids) else 0
    place = np.arange(len(ids), dtype=np.int64)
    first = np.zeros(terminals, np.int64)
    first[ids[::-1]] = place[::-1]
    left, right, size, firsts = [], [], [np.ones(terminals, np.int64)], [first]
    total, rounds, symbols = terminals, [], ids.astype(np.int64)
    sizes = size[0]

    def add(at: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> None:
        """New nonterminals for the pairs at `heads`; those at `at`, by `kind`, are replaced."""
        nonlocal total, symbols, place, sizes
        rounds.append(total)
        left.append(symbols[heads])
        right.append(symbols[heads + 1])
        size.append(sizes[left[-1]] + sizes[right[-1]])
        firsts.append(place[heads])
        sizes = np.concatenate([sizes, size[-1]])
        symbols = symbols.copy()
        symbols[at] = total + kind
        total += len(heads)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, place = symbols[stay], place[stay]

    while len(symbols) > 1:
        pair, inverse, count = np.unique(symbols[:-1] * np.int64(total) + symbols[1:], return_inverse=True, return_counts=True)
        if count.max() < 2:
            break
        # frequent pairs first, ties in an order that doesn't follow the places, else only one pair of a period is replaced in a round
        rank = np.zeros(len(pair), np.int64)
        often = np.flatnonzero(count > 1)
        rank[often[np.lexsort((tx.mix(pair[often].astype(np.uint64)), count[often]))]] = np.arange(1, len(often) + 1)
        own = rank[inverse]
        chosen = own > 0
        chosen[1:] &= own[1:] >= own[:-1]
        chosen[:-1] &= own[:-1] >= own[1:]
        at = _alternate(chosen)
        _, head, kind = np.unique(inverse[at], return_index=True, return_inverse=True)
        add(at, kind, at[head])
    while True:
        group = stretch[place]
        same = group[1:] == group[:-1]
        if not same.any():
            break
        at = _alternate(np.append(same, False))
        add(at, np.arange(len(at)), at)
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(terminals, flat(left), flat(right), flat(size), flat(firsts), rounds, symbols, place)


# runs that cross a boundary


def _same(ids: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from places a and b on, by `step` forwards or backwards, are the same; `most` at most."""
    done, size = 0, 32
    while done < most:
        n = min(size, most - done)
        if step > 0:
            same = ids[a + done : a + done + n] == ids[b + done : b + done + n]
        else:
            same = ids[a - done - n + 1 : a - done + 1][::-1] == ids[b - done - n + 1 : b - done + 1][::-1]
        if not same.all():
            return done + int(same.argmin())
        done += n
        size *= 4
    return done


def _squares(g: Grammar, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonterminal, period and start of what may be two periods, that end or begin at a nonterminal's boundary."""
    prefix = np.zeros(len(ids) + 1, np.uint64)
    value = tx.mix(ids.astype(np.uint64) + np.uint64(tx.OTHER))
    np.cumsum(value * tx.powers(tx.BASE, len(ids)), out=prefix[1:])
    power = tx.powers(tx.BASE, len(ids) + 1)
    size = g.size[g.terminals :]
    first = g.first[g.terminals :]
    a, b = g.size[g.left], g.size[g.right]
    boundary = first + a
    out = []
    for side, room in ((0, b), (1, a)):
        most = np.minimum(size // PERIODS, room // 2)
        most[size < LEAST] = 0
        ends = np.cumsum(most)
        at = 0
        while at < len(most):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            n = most[at:until]
            who = np.repeat(np.arange(at, until), n)
            q = np.arange(1, len(who) + 1) - np.repeat(np.cumsum(n) - n, n)
            start = boundary[who] - (2 * q if side else 0)
            middle = prefix[start + q]
            hit = (middle - prefix[start]) * power[q] == prefix[start + 2 * q] - middle
            out.append((who[hit], q[hit], start[hit]))
            at = until
    who, q, start = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((q, who))
    return who[order], q[order], start[order]


def crossing(g: Grammar, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each nonterminal that cross its boundary: the nonterminal (from 0), offset, length, period."""
    who, period, square = _squares(g, ids)
    found: list[tuple[int, int, int, int]] = []
    cut = np.flatnonzero(np.diff(who, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(who)], strict=False):
        k = int(who[a])
        low = int(g.first[g.terminals + k])
        high, boundary = low + int(g.size[g.terminals + k]), low + int(g.size[g.left[k]])
        q, start = period[a:b], square[a:b]
        while len(q):
            p, s = int(q[0]), int(start[0])
            begin = s - _same(ids, s - 1, s + p - 1, s - low, -1)
            end = s + p + _same(ids, s, s + p, high - s - p, 1)
            rest = np.ones(len(q), bool)
            rest[0] = False
            if end - begin >= 2 * p:  # else the hashes were wrong
                rest &= ~((q % p == 0) & (start >= begin) & (start + 2 * q <= end))  # multiples of the period inside the run
                if begin < boundary < end and end - begin >= max(LEAST, PERIODS * p):
                    found.append((k, begin - low, end - begin, p))
            q, start = q[rest], start[rest]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.array(x, np.int64) for x in zip(*sorted(set(found)), strict=True))


def translated(g: Grammar, who: np.ndarray, offset: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs at all places of their nonterminals in the derivation."""
    n = len(g.left)
    bounds = np.searchsorted(who, np.arange(n + 1))
    holds = np.zeros(g.terminals + n, bool)  # has runs, or a part has
    holds[g.terminals :] = np.diff(bounds) > 0
    steps = [*g.rounds, g.terminals + n]
    for a, b in zip(steps, steps[1:], strict=False):
        own = slice(a - g.terminals, b - g.terminals)
        holds[a:b] |= holds[g.left[own]] | holds[g.right[own]]
    stay = holds[g.symbols]
    symbols, places = g.symbols[stay], g.places[stay]
    out = []
    for a in g.rounds[::-1]:  # parts are of earlier rounds
        due = symbols >= a
        k, at = symbols[due] - g.terminals, places[due]
        count = bounds[k + 1] - bounds[k]
        run = np.repeat(bounds[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        start = np.repeat(at, count) + offset[run]
        out.append((start, start + length[run], period[run]))
        parts, where = np.concatenate([g.left[k], g.right[k]]), np.concatenate([at, at + g.size[g.left[k]]])
        stay = holds[parts]
        symbols, places = np.concatenate([symbols[~due], parts[stay]]), np.concatenate([places[~due], where[stay]])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that share a period of words as one; of those at the same words the smallest period."""
    if not len(start):
        return start, end, period
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    turn = np.cumsum(np.diff(period, prepend=period[0]) != 0) * (end.max() + 1)  # keeps periods apart
    far = np.maximum.accumulate(end + turn)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start + turn)[1:] > far[:-1] - period[1:]
    head = np.flatnonzero(fresh)
    start, end, period = start[head], np.maximum.reduceat(end, head), period[head]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[keep], end[keep], period[keep]


def runs_of(ids: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of stretches of symbols, by start, then period."""
    g = grammar(ids, stretch)
    return merged(*translated(g, *crossing(g, ids)))


# stretches that may hold runs


def _often(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which pairs come `least` times or more."""
    _, inverse, count = np.unique(a * (np.int64(b.max()) + 1) + b if len(b) else a, return_inverse=True, return_counts=True)
    return count[inverse] >= least


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all stretches in which each pair of neighbours comes three times or more, and their stretches' numbers."""
    n = len(hashes)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    ids, count = np.unique(tx.mix(hashes + row.astype(np.uint64) * np.uint64(tx.OTHER)), return_inverse=True, return_counts=True)[1:]
    ids = ids.astype(np.int32)
    often = count[ids] >= PERIODS  # each word of a run comes once a period
    words, group = np.arange(n), row
    joined = often[:-1] & often[1:] & (row[1:] == row[:-1]) if n else np.zeros(0, bool)  # to the word behind
    for _ in range(3):
        pair = np.flatnonzero(joined)
        own = np.unique(group[pair], return_inverse=True)[1] if len(pair) else pair
        label = np.unique(own * np.int64(n + 1) + ids[words[pair]], return_inverse=True)[1] if len(pair) else pair
        joined[pair] = _often(label, ids[words[pair + 1]], PERIODS - 1)
        # words in stretches of six or more
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2] + 1
        long = last - first >= LEAST
        first, size = first[long], (last - first)[long]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        group = np.repeat(np.arange(len(first)), size)
        before, words = len(words), words[at]
        joined = np.zeros(max(0, len(words) - 1), bool)
        joined[:] = group[1:] == group[:-1]
        if len(words) == before or not len(words):
            break
    return words, group


# documents


#: Words that are spelled out at once.
SPELLED = 1 << 17


def _spelled(data: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> Iterator[list[bytes]]:
    """Words as bytes, some at a time."""
    for at in range(0, len(words), SPELLED):
        some = words[at : at + SPELLED]
        yield [data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]


#: For each row's id and number of words: from which word on, and by how many, the words repeat; none where nothing is rewritten.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def find(part: pa.RecordBatch, rewrite: Rewrite | None = None) -> tuple[list[list[tuple[int, int, int]]], list[str], list[int], Callable[[int], bytes]]:
    """For each row its runs (start, length, period), the sha256 of what stays of it, its words, and a function to that text."""
    data, offsets = tx.utf8(part.column(part.schema.get_field_index("text")))
    starts, ends, hashes, bounds = pieces.hashed_words(data, offsets, ~tx.BLANK)
    n = np.diff(bounds)
    source = np.arange(len(starts))  # the word that stands at each place
    changed = set()
    if rewrite:
        for i, (doc_id, size) in enumerate(zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), n.tolist(), strict=True)):
            if size and (to := rewrite(doc_id, size)):
                (a, p), low = to, int(bounds[i])
                source[low + a : low + size] = low + a + np.arange(size - a) % p
                changed.add(i)
        hashes = hashes[source]
    words, group = stretches(hashes, bounds)
    del hashes
    whole = data.tobytes()
    found: list[list[tuple[int, int, int]]] = [[] for _ in n]
    if len(words):
        known: dict[bytes, int] = {}
        spelled = np.concatenate([np.fromiter((known.setdefault(w, len(known)) for w in some), np.int64, len(some)) for some in _spelled(whole, starts, ends, source[words])])
        symbols = np.unique(group * np.int64(len(known)) + spelled, return_inverse=True)[1]  # stretches share none
        for s, e, q in zip(*(x.tolist() for x in runs_of(symbols, group)), strict=True):
            first = int(words[s])
            row = int(np.searchsorted(bounds, first, "right")) - 1
            found[row].append((first - int(bounds[row]), e - s, q))
    # plain rows: each word and one blank; all of a slice at once
    plain = data.copy()
    stay = ~tx.BLANK[data]
    inner = np.ones(len(ends), bool)
    inner[bounds[1:][n > 0] - 1] = False  # no blank behind the last word
    plain[ends[inner]] = 0x20
    stay[ends[inner]] = True
    text = plain[stay].tobytes()
    letters = np.concatenate([[0], np.cumsum(ends - starts)])[bounds]
    at = letters + np.concatenate([[0], np.cumsum(np.maximum(0, n - 1))])

    def kept(i: int) -> bytes:
        if i not in changed and not found[i]:
            return text[at[i] : at[i + 1]]
        drop = np.zeros(n[i] + 1, np.int64)
        for s, length, q in found[i]:
            drop[s + q] += 1
            drop[s + length] -= 1
        return b" ".join(b" ".join(some) for some in _spelled(whole, starts, ends, source[bounds[i] : bounds[i + 1]][np.cumsum(drop[:-1]) == 0]))

    return found, [hashlib.sha256(kept(i)).hexdigest() for i in range(len(n))], n.tolist(), kept


def collapse(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with `runs` (by start, then period) and `collapsed`: the words joined by blanks, without those that any run holds
    after its first period; null for a null text."""

    def work(part: pa.RecordBatch) -> dict[str, object]:
        found, _, _, kept = find(part)
        null = part.column(part.schema.get_field_index("text")).is_null().to_pylist()
        return {"runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows] for rows in found], "collapsed": [None if x else kept(i).decode() for i, x in enumerate(null)]}

    return tx.map_text(documents, "text", work, [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())], keep)


def report(documents: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """`doc_id`, `n_runs`, `start`, `length`, `period` and `exponent_milli` of the run of the greatest exponent (ties: smallest start, then
    period; nulls without one), `runs_sha256` and `collapsed_sha256` of every row, whose words `rewrite` may change first."""
    long, string = T.LongType(), T.StringType()
    fields = [T.StructField("doc_id", long), T.StructField("n_runs", long), *[T.StructField(c, long) for c in ("start", "length", "period", "exponent_milli")], T.StructField("runs_sha256", string), T.StructField("collapsed_sha256", string)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE):
                found, digests, _, _ = find(part, rewrite)
                best = [min(rows, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if rows else None for rows in found]
                of = lambda k, best=best: pa.array([b and b[k] for b in best], pa.int64())
                lines = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(rows, key=lambda r: (r[0], r[2]))).encode()).hexdigest() for rows in found]
                milli = pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), of(0), of(1), of(2), milli, pa.array(lines), pa.array(digests)], names=[f.name for f in fields])

    return documents.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
