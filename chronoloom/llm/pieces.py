"""Words of texts of any length: bytes are worked on in pieces that end between words, so only what is kept for each word grows
with a text."""

from __future__ import annotations

import numpy as np

from . import text as tx

#: Bytes of a piece; one longer word makes a longer piece.
PIECE = tx.SLICE_BYTES
#: The words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def hashed_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and the bounds of each row's words; with `lower` A-Z count as a-z."""
    n, at = len(data), 0
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    table = inside.copy()
    if lower:
        table[65:91] = table[97:123]
    while at < n:
        end = min(n, at + PIECE)
        while end < n and table[data[end]]:
            rest = ~table[data[end : end + PIECE]]
            end += int(rest.argmax()) if rest.any() else len(rest)
        piece = data[at:end]
        if lower:
            piece = tx.lower_ascii(piece)
        own = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end)] - at
        a, b, _ = tx.word_bounds(piece, np.concatenate([[0], own, [end - at]]).astype(np.int64), inside)
        starts.append(a + at)
        ends.append(b + at)
        hashes.append(tx.span_hash(tx.prefix_hash(piece), a, b))
        at = end
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(first, offsets)
