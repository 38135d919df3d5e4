"""JSON out of free answers: the first candidate that parses, as text for `from_json`.

A value that is an object or array ends at the bracket that closes its first one, brackets inside of strings aside. A bracket automaton over
the bytes of a whole batch finds these fragments: seen from a bracket, another one is inside a string if the quotes between them are
odd in number, so the brackets of a text are two sequences, and in each a bracket is closed by the next one of its depth. Only such
fragments are parsed, from the left.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:\w+)?\s*(.*?)```", re.DOTALL)
_THOUGHT = re.compile(r"<think>.*?</think>", re.DOTALL)
QUOTE, BACKSLASH = ord('"'), ord("\\")


def fragments(texts: list[str]) -> list[list[str]]:
    """For each text the balanced fragments that begin with a bracket, by their beginnings."""
    parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    whole = b"".join(parts)
    data = np.frombuffer(whole, np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != BACKSLASH, place, -1))  # the last byte up to here that is no backslash
    quote = data == QUOTE
    at = np.flatnonzero(quote)
    at = at[at > 0]
    quote[at] = (at - 1 - plain[at - 1]) % 2 == 0  # else it is escaped
    odd = np.cumsum(quote) % 2
    opens = (data == ord("{")) | (data == ord("["))
    at = np.flatnonzero(opens | (data == ord("}")) | (data == ord("]")))
    row = np.repeat(np.arange(len(parts)), size)[at]
    order = np.lexsort((at, odd[at], row))  # a text's two sequences
    at, sequence = at[order], (row * 2 + odd[at])[order]
    up = opens[at]
    depth = np.cumsum(np.where(up, 1, -1))
    order = np.lexsort((np.arange(len(at)), depth + ~up, sequence))  # an opening bracket, then the closing one of its depth
    found: list[list[str]] = [[] for _ in texts]
    if len(at):
        at, up, level, sequence = at[order], up[order], (depth + ~up)[order], sequence[order]
        pair = np.flatnonzero(up[:-1] & ~up[1:] & (level[:-1] == level[1:]) & (sequence[:-1] == sequence[1:]))
        pair = pair[np.argsort(at[pair])]
        for a, b, r in zip(at[pair].tolist(), at[pair + 1].tolist(), (sequence[pair] // 2).tolist(), strict=True):
            found[r].append(whole[a : b + 1].decode("utf-8", "surrogatepass"))
    return found


def _parsed(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def first_jsons(texts: list[str | None]) -> list[str | None]:
    """Of each answer the whole text, then fenced blocks, then the text without thoughts; of each the whole, then its fragments."""
    out: list[str | None] = [None] * len(texts)
    todo = [i for i, t in enumerate(texts) if t is not None]
    for parts_of in (lambda t: [t], _FENCE.findall, lambda t: [_THOUGHT.sub("", t)]):
        rows = [(i, part.strip()) for i in todo for part in parts_of(texts[i])]
        for (i, part), inside in zip(rows, fragments([p for _, p in rows]), strict=True):
            for candidate in (part, *inside):
                if out[i] is None:
                    out[i] = _parsed(candidate)
        todo = [i for i in todo if out[i] is None]
    return out


def parse_llm_json(text: Column | str) -> Column:
    """The JSON text of an answer, null if nothing in it parses."""

    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series(first_jsons(texts.tolist()), index=texts.index, dtype=object)

    return F.pandas_udf(parse, "string")(text)
