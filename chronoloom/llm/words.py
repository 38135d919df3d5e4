"""Words of byte-level tokenizers, found for all texts of a slice at once, and a table of what was made of each word.

The split pattern looks at classes of characters alone, letters, numbers, white space and others, and at a few fixed strings, so words
start where the class changes, but for single blanks, which belong to the word behind them, and contractions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import regex

from . import text as tx

#: Fixed value: the split of byte-level tokenizers of this kind, which some of their files name but don't state.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, WHITE = range(4)
BLANK, APOSTROPHE = 0x20, 0x27

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, as the regular expressions see it."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        every = points.astype("<u4").tobytes().decode("utf-32-le")
        for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for found in regex.finditer(what, every):
                table[points[found.start() : found.end()]] = kind
        _classes.append(table)
    return _classes[0]


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the characters of two to four bytes that start at `at`."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b, c, d = (padded[at + i].astype(np.int32) for i in range(4))
    two = (a & 0x1F) << 6 | b & 0x3F
    three = (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F
    four = (a & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F
    return np.where(a < 0xE0, two, np.where(a < 0xF0, three, four))


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in the bytes of some rows, and the bounds of each row's words. A word ends where the next one starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    m = len(at)
    if not m:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    byte, table = data[at], classes()
    kind = table[byte]
    wide = np.flatnonzero(byte >= 0x80)
    kind[wide] = table[code_points(data, at[wide])]
    edge = np.zeros(m + 1, bool)  # first characters of rows
    edge[np.searchsorted(at, offsets)] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last = np.zeros(m, bool)  # the last of some white space, before something else
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
    start |= last
    start[np.flatnonzero(last & (byte == BLANK)) + 1] = False
    # contractions, where a word starts with an apostrophe before a letter
    quote = np.flatnonzero((byte[:-1] == APOSTROPHE) & start[:-1] & (kind[1:] == LETTER) & ~edge[1:-1] & ((kind[:-1] != kind[1:]) | start[1:]))
    if len(quote):
        letters = np.append(byte, [0, 0])
        one, two = letters[quote + 1], letters[quote + 2]
        inside = np.append(kind, [OTHER, OTHER])
        same = ~np.append(edge, [True, True])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = same[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, n in ((quote[short], 1), (quote[pair], 2)):
            start[found + 1] = False
            rest = found + 1 + n
            start[rest[(inside[rest] == LETTER) & same[rest]]] = True
    starts = at[start]
    return starts, np.searchsorted(starts, offsets)


def gathered(first: np.ndarray, count: np.ndarray, values: np.ndarray) -> np.ndarray:
    """`count` values from place `first` on, for each of some entries, one after the other."""
    end = np.cumsum(count)
    return values[np.repeat(first - (end - count), count) + np.arange(end[-1] if len(end) else 0)]


class Table:
    """A few numbers for each word met so far, `most` words at most, in arrays. Words are told apart by 128 bits of hashes."""

    def __init__(self, most: int) -> None:
        self.most, self.salt = most, 0
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count, self.values = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def look_up(self, data: np.ndarray, starts: np.ndarray, make: Callable[[list[bytes]], Sequence[Sequence[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the place and number of its values, and all values; `make` makes those of new words."""
        if len(self.key) > self.most:
            self.clear()
        ends = np.append(starts[1:], len(data))[: len(starts)]
        one, other = (tx.span_hash(tx.prefix_hash(data, base), starts, ends, base) for base in (tx.BASE, tx.OTHER))
        while True:
            keys, at, inverse = np.unique(one if not self.salt else tx.mix(one + np.uint64(self.salt) * other), return_index=True, return_inverse=True)
            check = other[at]
            place = np.searchsorted(self.key, keys)
            near = np.minimum(place, max(0, len(self.key) - 1))
            known = (self.key[near] == keys) if len(self.key) else np.zeros(len(keys), bool)
            if (other == check[inverse]).all() and (not known.any() or (self.check[near[known]] == check[known]).all()):
                break
            self.clear()  # two words share 64 bits: all hashes are made anew
            self.salt += 1
        new = np.flatnonzero(~known)
        if len(new):
            whole = np.ascontiguousarray(data).tobytes()
            made = make([whole[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            count = np.fromiter(map(len, made), np.int64, len(made))
            first = len(self.values) + np.cumsum(count) - count
            self.values = np.append(self.values, np.fromiter((v for m in made for v in m), np.int32, int(count.sum())))
            self.key, self.check = np.insert(self.key, place[new], keys[new]), np.insert(self.check, place[new], check[new])
            self.first, self.count = np.insert(self.first, place[new], first), np.insert(self.count, place[new], count)
            place = np.searchsorted(self.key, keys)
        return self.first[place][inverse], self.count[place][inverse], self.values
