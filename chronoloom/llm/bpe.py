"""Byte-level BPE: encoding by merge replay over distinct words, and decoding.

Merges work inside a word (a match of the split pattern), so a word is encoded once wherever it stands. All new words of a batch
lie in one array of tokens with neighbour links. An inverted index lists the places of token pairs by the rank of the token that they
make; sweeps over it apply the merges in rank order, each word's smallest rank at all its places, and a merge gives new ranks to its
two neighbours alone. The index is sorted once: only touched places leave it and are put in again where their new ranks belong.
Documents then take their words' ids.

Words are independent, so the ids are those of a replay over all words of the corpus. Distinct words are collected within a slice of
texts and remembered by the worker, not by the corpus: taking ids back to documents would shuffle each document's words.

Defined results: a null or empty text has no ids and decodes to no bytes; special strings are ordinary text; repeated rows get
the same result each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as tx
from . import words

#: Words whose ids a worker remembers, about 40 MB.
REMEMBERED = 800_000
#: Bytes of new words that are replayed together at most.
TOGETHER = 4 << 20
#: The rank of tokens that don't merge.
NONE = np.int32(2**31 - 1)
#: Above any token, to write a pair of tokens as one number.
TOKENS = 1 << 31


class Vocabulary:
    """Ranks of byte strings, and the ids of words met so far."""

    def __init__(self, rank: dict[bytes, int], pattern: str) -> None:
        self.rank = rank
        self.byte = np.array([rank[bytes([i])] for i in range(256)], np.int32)
        self.pattern = None if pattern == words.PATTERN else regex.compile(pattern)
        pairs = [(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        key = left * TOKENS + right
        order = np.argsort(key)
        self.pair_key, self.pair_rank = np.append(key[order], np.iinfo(np.int64).max), np.append(made[order], NONE).astype(np.int32)
        most = max(rank.values()) + 1
        self.sorts = np.uint16 if most < 1 << 16 else np.int32  # two bytes are sorted by radix
        self.table = words.Table(REMEMBERED)
        bytes_of = {i: b for b, i in rank.items()}
        self.shown = [_flat([bytes_of.get(i, b"") for i in range(most)]), _flat([b"%d " % i for i in range(most)])]

    def _ranks(self, token: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each place, `NONE` if it doesn't merge."""
        nxt = after[at]
        return self._pairs(np.where(nxt < 0, -1, token[at]), token[nxt])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where(left < 0, -1, left.astype(np.int64) * TOKENS + right)
        place = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[place] == key, self.pair_rank[place], NONE)

    def replay(self, new: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        out: list[tuple[int, ...]] = [(r,) if (r := self.rank.get(w)) is not None else () for w in new]  # a word that is a token is taken whole
        open_ = [i for i, x in enumerate(out) if not x and new[i]]
        size = np.array([len(new[i]) for i in open_], np.int64)
        token = self.byte[np.frombuffer(b"".join(new[i] for i in open_), np.uint8)]
        n = len(token)
        word = np.repeat(np.arange(len(open_)), size)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        ends = np.cumsum(size)
        before[ends - size], after[ends - 1] = -1, -1
        rank = self._ranks(token, after, np.arange(n))
        index = np.flatnonzero(rank != NONE)
        index = index[np.argsort(rank[index].astype(self.sorts), kind="stable")]  # places by the rank of their pair
        least = np.full(len(open_), NONE)
        stale = np.zeros(n, bool)
        while len(index):
            least[word[index[::-1]]] = rank[index[::-1]]  # a word's smallest rank comes last
            i = np.sort(index[rank[index] == least[word[index]]])
            # of places that follow one another every second one
            line = np.arange(len(i))
            joins = np.append(False, after[i[:-1]] == i[1:])
            i = i[(line - np.maximum.accumulate(np.where(joins, 0, line))) % 2 == 0]
            j = after[i]
            k = after[j]
            was, other, least_rank = token[i], token[j], rank[i]
            token[i], token[j], after[i] = least_rank, -1, k
            before[k[k >= 0]] = i[k >= 0]
            rank[j] = NONE
            touched = np.concatenate([i, before[i[before[i] >= 0]]])
            rank[touched] = self._ranks(token, after, touched)
            # where a smaller rank has come up in a word, or would have before the next place, it goes before all but the first place
            line = np.flatnonzero(k[:-1] == i[1:])
            line = line[self._pairs(least_rank[line], was[line + 1]) < least_rank[line]]
            smaller = np.append(touched[rank[touched] < least[word[touched]]], i[line])
            if len(smaller):
                back = np.isin(word[i], word[smaller]) & np.append(False, word[i[1:]] == word[i[:-1]])
                i2, j2, k2 = i[back], j[back], k[back]
                token[i2], token[j2], after[i2] = was[back], other[back], j2
                before[k2[k2 >= 0]] = j2[k2 >= 0]
                more = np.concatenate([i2, j2, before[i2]])  # not the first of a word, so there is one before
                rank[more] = self._ranks(token, after, more)
                touched = np.concatenate([touched, more])
            # what was touched leaves the index, and comes in again at its new rank
            stale[j] = stale[touched] = True
            index = index[~stale[index]]
            new_ = np.flatnonzero(stale) if len(touched) * 8 > n else np.unique(touched)
            stale[j] = stale[touched] = False
            new_ = new_[rank[new_] != NONE]
            new_ = new_[np.argsort(rank[new_], kind="stable")]
            index = np.insert(index, np.searchsorted(rank[index], rank[new_]), new_)
        alive = token >= 0
        flat, bounds = token[alive].tolist(), np.append(0, np.cumsum(np.bincount(word[alive], minlength=len(open_)))).tolist()
        for i, a, b in zip(open_, bounds[:-1], bounds[1:], strict=True):
            out[i] = tuple(flat[a:b])
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and the bounds of each text's."""
        data, offsets = tx.utf8(column)
        if self.pattern is None:
            starts, bounds = words.split(data, offsets)
        else:
            cut = [[w.encode() for w in self.pattern.findall(t or "")] for t in column.to_pylist()]
            data = np.frombuffer(b"".join(w for c in cut for w in c), np.uint8)
            starts = np.cumsum([0, *(len(w) for c in cut for w in c)])[:-1]
            bounds = np.cumsum([0, *map(len, cut)])
        first, count, values = self.table.look_up(data, starts, self._made)
        return words.gathered(first, count, values), np.append(0, np.cumsum(count))[bounds]

    def _made(self, new: list[bytes]) -> list[tuple[int, ...]]:
        out, some, size = [], [], 0
        for w in new:
            some.append(w)
            size += len(w)
            if size >= TOGETHER:
                out += self.replay(some)
                some, size = [], 0
        return out + self.replay(some)

    def _written(self, ids: np.ndarray, bounds: np.ndarray, form: int) -> tuple[np.ndarray, np.ndarray]:
        flat, at = self.shown[form]
        size = np.diff(at)[ids]
        return words.gathered(at[ids], size, flat), np.append(0, np.cumsum(size))[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids."""
        flat, at = self._written(ids, bounds, 0)
        whole = flat.tobytes()
        return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def id_digests(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """sha256 of each text's ids in decimal digits with a space between."""
        flat, at = self._written(ids, bounds, 1)
        whole = flat.tobytes()
        return [hashlib.sha256(whole[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def digests(self, ids: np.ndarray, bounds: np.ndarray, column: pa.Array) -> list[str]:
        """sha256 of the bytes that the ids of each text decode to; an error if these aren't the text's."""
        data, offsets = tx.utf8(column)
        got = self.decode(ids, bounds)
        if [len(x) for x in got] != np.diff(offsets).tolist() or b"".join(got) != data.tobytes():
            raise ValueError(f"{len(ids)} ids of {len(got)} texts decode to bytes that differ from their texts'")
        return [hashlib.sha256(x).hexdigest() for x in got]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file, once for each worker."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as file:
            _loaded[path, pattern] = Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}, pattern)
    return _loaded[path, pattern]


def encode(documents: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The columns of `keep`, and `n_tokens` and `ids` of every row; with `digest`, the ids are decoded again in the same pass,
    checked against the text, and `decoded_sha256` has the digest of the decoded bytes."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded_sha256", T.StringType())] * digest

    def work(part: pa.RecordBatch) -> dict[str, object]:
        column, known = part.column(part.schema.get_field_index("text")), vocabulary(ranks, pattern)
        ids, bounds = known.encode(column)
        out = {"n_tokens": np.diff(bounds), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))}
        return out | {"decoded_sha256": known.digests(ids, bounds, column)} if digest else out

    return tx.map_text(documents, "text", work, fields, keep)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`encoded` with `decoded`, the bytes of its `ids`, in place of them."""
    names = [c for c in encoded.columns if c != "ids"]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids")).fill_null([])
            bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            got = pa.array(vocabulary(ranks, pattern).decode(lists.flatten().to_numpy(zero_copy_only=False), bounds), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), got], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([encoded.schema[c] for c in names] + [T.StructField("decoded", T.BinaryType())]))


def round_trip(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids_sha256` of the ids in decimal digits with a space between, `decoded_sha256` of the bytes that
    they decode to: encoding and decoding in one pass, when the ids themselves are not wanted."""

    def work(part: pa.RecordBatch) -> dict[str, object]:
        column, known = part.column(part.schema.get_field_index("text")), vocabulary(ranks, pattern)
        ids, bounds = known.encode(column)
        return {"n_tokens": np.diff(bounds), "ids_sha256": known.id_digests(ids, bounds), "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in known.decode(ids, bounds)]}

    return tx.map_text(documents, "text", work, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], ["doc_id"])
