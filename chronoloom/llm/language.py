"""Language of texts: script ranges narrow the candidates of a word, and Viterbi over word scores labels spans.

A word's score in a language is the log probability of its hashed byte n-grams there, learnt by counting all n-grams of all
labelled texts. The best path of languages over the words of a text pays a penalty for each switch, so single odd words
don't cut a span, and mixed texts come out as spans of one language each.

Defined results: a null text, a text without a letter, and any text when nothing was learnt are `und` with score 0 and no
spans; texts with a null label are not learnt from; ties go to the language first by code point; repeated rows get the same
result each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

#: Hash buckets of each n-gram length.
BUCKETS = 1 << 15
LENGTHS = (2, 3, 4)
#: Log-probability that a change of language costs.
PENALTY = 12.0
#: A script is a language's own if this share of its words have it.
SCRIPT_SHARE = 0.005
#: Count added to each n-gram.
SMOOTH = 0.5
UNKNOWN = "und"
#: Bytes of text that are labelled together: a step takes all rows of a slice one word on, so more rows make fewer steps; for more than
#: sixteen languages it gets smaller, as their scores take the memory.
SLICE, LANGUAGES_TOGETHER = 1_000_000, 16
#: First and last code point of the scripts that are told apart; script 0 is Latin and all the rest.
SCRIPTS = [
    (0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0980, 0x09FF),
    (0x0B80, 0x0BFF), (0x0E00, 0x0E7F), (0x10A0, 0x10FF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF),
]
N_SCRIPTS = len(SCRIPTS) + 1

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_any_letter = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probabilities, n-gram buckets by languages
    scripts: np.ndarray  # scripts by languages: whether a word of the script may be of the language


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented Latin-1 capitals."""
    out = tx.lower_ascii(data)
    if len(out) > 1:
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accent] += np.uint8(0x20)
    return out


def _scripts(data: np.ndarray) -> np.ndarray:
    """The script at each byte that leads a code point of two or three bytes, elsewhere 0."""
    out = np.zeros(len(data), np.uint8)
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int32)
    at = np.flatnonzero((data >= 0xC4) & (data < 0xF0))
    two = data[at] < 0xE0
    point = np.where(two, (padded[at] & 0x1F) << 6 | padded[at + 1] & 0x3F, (padded[at] & 0x0F) << 12 | (padded[at + 1] & 0x3F) << 6 | padded[at + 2] & 0x3F)
    for k, (first, last) in enumerate(SCRIPTS, 1):
        out[at[(point >= first) & (point <= last)]] = k
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each letter, word by word, for each length; where each word starts among the
    letters; the words' scripts and letters; the bounds of each row's words."""
    low = _lower(data)
    starts, ends, bounds = tx.word_bounds(low, offsets, _letter)
    size = ends - starts
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    total = int(size.sum())
    at = np.arange(total) + np.repeat(starts - first, size)
    stop = np.repeat(ends, size)
    padded = np.concatenate([low, np.full(4, 32, np.uint8)])
    value = padded[at].astype(np.uint32)
    if total:
        value[first] += np.uint32(256)  # a word's first letter differs from the same letter inside
    out, shift = [], 0
    for n in range(1, max(LENGTHS)):
        value = value * np.uint32(0x01000193) + np.where(at + n < stop, padded[np.minimum(at + n, len(low))], np.uint8(32)).astype(np.uint32)
        if n + 1 in LENGTHS:
            out.append(((value * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32) + shift)
            shift += BUCKETS
    script = np.maximum.reduceat(_scripts(data)[at], first) if total else np.zeros(0, np.uint8)
    return out, first, script, size, bounds


def fit(labelled: DataFrame) -> Model | None:
    """The model from all rows of `labelled` (`text`, `lang`) with a language; None if there is none.

    Each task adds up its rows' n-grams in one array for each language; these sums are added by key, so what is shuffled and
    what comes to the driver is bounded by languages times buckets, whatever the number of texts.
    """
    buckets = BUCKETS * len(LENGTHS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in tx.slices(batch, "text"):
                column = part.column(part.schema.get_field_index("text"))
                langs = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
                for lang in set(langs):
                    grams, _, script, _, _ = _grams(*tx.utf8(column.filter(pa.array(langs == lang))))
                    have = sums.setdefault(lang, np.zeros(buckets + N_SCRIPTS, np.int64))
                    for x in grams:
                        have[:buckets] += np.bincount(x, minlength=buckets)
                    have[buckets:] += np.bincount(script, minlength=N_SCRIPTS)
        for lang, have in sums.items():
            some = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(have[some])], names=["lang", "bucket", "n"])

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = tx.map_arrow(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]))
    if not languages:
        return None
    counts = np.zeros((buckets + N_SCRIPTS, len(languages)))
    counts[sums["bucket"].to_numpy(), sums["lang"].map(languages.index).to_numpy()] = sums["n"].to_numpy()
    table = np.log(counts[:buckets] + SMOOTH).reshape(len(LENGTHS), BUCKETS, -1)
    table -= np.log(np.exp(table).sum(axis=1, keepdims=True))
    words = counts[buckets:]
    own = words >= SCRIPT_SHARE * np.maximum(1, words.sum(axis=0))
    own[~own.any(axis=1)] = True  # a script that no language has excludes none
    return Model(languages, (table / len(LENGTHS)).reshape(buckets, -1).astype(np.float32), own)


def _paths(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word: the path of the largest sum of scores less `penalty` for each change, row by row.

    All rows advance together, one word a step, the longest rows first, so a step is a few array operations.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first = bounds[:-1][order]
    out = np.zeros(len(scores), np.int32)
    if not len(scores):
        return out
    steps = int(size.max())
    live = len(size) - np.searchsorted(np.sort(size), np.arange(1, steps + 1), "left")
    stay = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.int32)
    best = scores[first[: live[0]]].astype(np.float64)
    final = np.zeros((len(size), scores.shape[1]))
    final[: live[0]] = best
    for t in range(1, steps):
        n = live[t]
        best = best[:n]
        at = first[:n] + t
        top = best.argmax(axis=1)
        jump = best[np.arange(n), top] - penalty
        keep = best >= jump[:, None]
        best = np.where(keep, best, jump[:, None]) + scores[at]
        stay[at], came[at] = keep, top
        final[:n] = best
    state = final.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        now = state[:n]
        out[at] = now
        if t:
            state[:n] = np.where(stay[at, now], now, came[at])
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("lang", T.StringType())]))


def predict(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), prefix: str = "", penalty: float = PENALTY) -> DataFrame:
    """The columns of `keep`, and for each row `lang_pred`, `score` and `lang_spans`, their names behind `prefix`.

    `lang_spans` are runs of words (runs of letters, from 0) in one language; `lang_pred` is the language that most bytes of
    letters are in, and `score` the share of these bytes in it.
    """
    names = [prefix + x for x in ("lang_pred", "score", "lang_spans")]

    def work(part: pa.RecordBatch) -> dict[str, object]:
        column = part.column(part.schema.get_field_index("text"))
        n = len(column)
        langs, share, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
        if model is not None:
            data, offsets = tx.utf8(column)
            grams, first, script, size, bounds = _grams(data, offsets)
            if len(size):
                scores = model.table[grams[0]]
                for x in grams[1:]:
                    scores += model.table[x]
                scores = np.add.reduceat(scores, first, axis=0)
                scores[~model.scripts[script]] = -1e6
                path = _paths(scores, bounds, penalty)
                letters = np.zeros((n, len(model.languages)))
                np.add.at(letters, (np.repeat(np.arange(n), np.diff(bounds)), path), size)
                top, total = letters.argmax(axis=1), letters.sum(axis=1)
                change = np.zeros(len(path), bool)
                change[1:] = path[1:] != path[:-1]
                plain = np.zeros(256, bool)
                plain[[*range(65, 91), *range(97, 123)]] = True
                ascii_letters = np.concatenate([[0], np.cumsum(plain[data])])
                for i in np.flatnonzero(total > 0):
                    a, b = bounds[i], bounds[i + 1]
                    if ascii_letters[offsets[i + 1]] == ascii_letters[offsets[i]] and not _any_letter.search(column[int(i)].as_py()):
                        continue
                    langs[i], share[i] = model.languages[top[i]], letters[i, top[i]] / total[i]
                    cuts = [a, *(a + 1 + np.flatnonzero(change[a + 1 : b])).tolist(), b]
                    spans[i] = [{"first_word": int(x - a), "last_word": int(y - a - 1), "lang": model.languages[path[x]]} for x, y in zip(cuts, cuts[1:], strict=False)]
        return dict(zip(names, (langs, share, spans), strict=True))

    kinds = (T.StringType(), T.DoubleType(), SPANS)
    return tx.map_text(documents, "text", work, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], keep, SLICE * LANGUAGES_TOGETHER // max(LANGUAGES_TOGETHER, len(model.languages) if model else 1))
