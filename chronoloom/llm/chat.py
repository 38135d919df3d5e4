"""Chat formatting in budgeted windows.

The turns of a conversation are cut into windows of at most `budget` tokens. Prefix sums of the turns' tokens choose the spans,
which begin and end at turns. A conversation's first turn, if it is a system turn, stands at the head of every window; later
windows repeat the last turns before them, up to `history` tokens. Repeated turns are context: the loss mask covers each
assistant text once, in the window that has it as its own.

Template: `### role: text</turn>` and a newline for a window's own turn, `#~# role: text</turn>` for a repeated one. Inside roles
and texts, backslashes and the control strings are escaped by a backslash and a letter, so the output reads back exactly.

Defined results: rows of one conversation are ordered by turn, role, text (nulls first); null roles and texts are empty, and
rows with a null conversation are one conversation; a turn larger than the budget is a window of its own, and where the system turn
and the history leave no room, each window has one own turn; tokens of a turn are those of its text, as the tokenizer's library counts
them, plus `OVERHEAD`; repeated rows are turns of their own; extra columns are ignored. A conversation streams through one
task in the order of its turns, at most `BUFFER` turns in memory, since its turns follow from one another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

BUDGET = 512
HISTORY = 128
OVERHEAD = 4
BUFFER = 2048
OWN, REPEATED, END = "###", "#~#", "</turn>\n"
#: What is escaped, and by what; the backslash first.
ESCAPES = {"\\": "\\\\", "###": "\\h", "#~#": "\\r", "</turn>": "\\t", ": ": "\\c"}
_plain = {v[1]: k for k, v in ESCAPES.items()}
_escaped = re.compile(r"\\(.)", re.DOTALL)
_special = re.compile("|".join(re.escape(k) for k in ESCAPES))
WINDOWS = "conv_id long, window_no long, text string, n_tokens long, loss array<struct<start:int,end:int>>"

Turn = tuple[str, str, int]


def escape(text: str) -> str:
    return _special.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _plain[m[1]], text)


def spans(sizes: np.ndarray, first_room: int, room: int) -> list[int]:
    """Where windows end, by prefix sums: each takes the turns that fit, one at least."""
    total = np.cumsum(sizes)
    out, start = [], 0
    while start < len(sizes):
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + (room if out else first_room), "right")))
        out.append(end)
        start = end
    return out


def window(system: Turn | None, history: list[Turn], own: list[Turn]) -> tuple[str, int, list[dict]]:
    """The text of a window, its tokens, and where its loss counts: the own assistant texts."""
    parts, loss, at, size = [], [], 0, 0
    for mark, turns in ((REPEATED, [system] if system else []), (REPEATED, history), (OWN, own)):
        for role, text, n in turns:
            head, body = f"{mark} {escape(role)}: ", escape(text)
            if mark == OWN and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
            size += n
    return "".join(parts), size, loss


def windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each window: `conv_id`, `window_no` from 0, `text`, `n_tokens`, and `loss`, the spans that count.

    `tokenizer` is the file whose tokens the budget and the history count.
    """

    def flush(conv: int | None, state: dict, last: bool) -> Iterator[tuple]:
        turns: list[Turn] = state["turns"]
        kept = min(history, budget // 4)
        system = state["system"]
        used = system[2] if system and state["window"] else 0
        ends = spans(np.array([t[2] for t in turns], np.int64), budget - used - (kept if state["window"] else 0), budget - (system[2] if system else 0) - kept)
        start = 0
        for end in ends if last else ends[:-1]:
            own = turns[start:end]
            yield (conv, state["window"], *window(system if state["window"] else None, state["tail"], own))
            state["window"] += 1
            tail, total = [], 0
            for t in reversed(own):
                if total + t[2] > kept or (system is not None and t is system):
                    break
                tail.append(t)
                total += t[2]
            state["tail"] = tail[::-1]
            start = end
        state["turns"] = turns[start:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            sizes = tokens.counter(tokenizer)(batch.column(2)).tolist()
            for conv, role, text, n in zip(*(batch.column(i).to_pylist() for i in range(3)), sizes, strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out += flush(now, state, True)
                    now, state = conv, {"turns": [], "tail": [], "window": 0, "system": None, "any": False}
                turn = (role, text, OVERHEAD + n)
                if not state["any"]:
                    state["any"], state["system"] = True, turn if role == "system" else None
                state["turns"].append(turn)
                if len(state["turns"]) >= BUFFER:
                    out += flush(now, state, False)
                if len(out) >= 1000:
                    yield _windows(out)
                    out = []
        if state is not None:
            out += flush(now, state, True)
        yield _windows(out)

    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, WINDOWS)


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("window_no", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def read_turns(text: str) -> list[tuple[bool, str, str]]:
    """The turns of a window: whether it is its own, role, text."""
    out = []
    for piece in text.split(END)[:-1]:
        head, _, body = piece.partition(": ")
        out.append((head.startswith(OWN), unescape(head[4:]), unescape(body)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from windows: `conv_id`, `n_turns`, `turns_sha256`, `loss_chars`, `loss_sha256`, `formatted_chars`, `n_windows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def close() -> None:
            if state is not None:
                out.append({"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5]})

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    close()
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for own, role, text in read_turns(row["text"]):
                    if own:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    target = unescape(row["text"][span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(row["text"])
                state[5] += 1
        close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]))

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window_no")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
