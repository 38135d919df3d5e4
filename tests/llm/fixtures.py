"""Small tables with the odd cases: nulls in every column, empty, long and repeated texts, ties, extra columns."""

import os
import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, kept string, class long"


def prose(seed: int, words: int, alphabet: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(words))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join("zz" + w if rng.random() < share else w for w in text.split(" "))


def odd_rows() -> list[tuple]:
    passage = prose(900, 90)
    rows: list[tuple] = []
    for i in range(40):
        rows.append((i, prose(i, 10 + 7 * i), "en" if i % 2 else "fr", f"src{i % 4}"))
    base = prose(500, 200)
    rows += [(100 + i, edited(base, i, 0.02 * (i % 4)), "en", "src1") for i in range(12)]
    rows += [(200 + i, f"{prose(600 + i, 30)} {passage} {prose(700 + i, 30)}", "fr", None) for i in range(5)]
    rows += [
        (300, None, None, None), (301, "", "en", "src0"), (302, " \t\n ", None, "src0"), (303, "x", "en", ""), (304, "one two three", "en", "src2"), (305, "One TWO three", "fr", "src2"),
        (None, "a row without an id, which has ten words at least, as it were", "en", "src3"), (None, None, None, None), (306, "ab " * 4000, "en", "src3"), (307, "1234 5678 --- !!", "en", "src0"),
        (308, "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "en", "src0"), (309, "İstanbul ßtraße naïve 漢字かな مرحبا Привет мир <|endoftext|> 'll we've  \n\n x", "de", "src9"),
        (310, prose(800, 300) + "\n" + prose(800, 300), "en", "src1"), (0, prose(0, 10), "fr", "src0"), (0, prose(0, 10), "fr", "src0"), (311, passage, "fr", "src1"), (312, "é" * 900, "fr", "src1"),
        (313, prose(1, 17) + " and more", "en", "src1"), (314, "\r\n".join(["same line here"] * 6), "en", "src5"), (315, prose(77, 20000), "en", "src5"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, 7, "clash", "clash", 5) for i, t, lang, s in rows]


def odd(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def written(rows: list[tuple]) -> str:
    """A folder with the rows as `documents`, and small `labels`, `benchmark` and `conversations`."""
    path = tempfile.mkdtemp(prefix="spark-")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}), os.path.join(path, "documents.parquet"))
    pq.write_table(pa.table({"doc_id": pa.array([1, 2, 3, None], pa.int64()), "quality": pa.array([1, None, 0, 1], pa.int32()), "toxic": pa.array([0, 0, 0, 0], pa.int32())}), os.path.join(path, "labels.parquet"))
    items = [(1, prose(900, 90)), (None, "x"), (3, None), (3, ""), (4, "one two")]
    pq.write_table(pa.table({"item_id": pa.array([r[0] for r in items], pa.int64()), "text": pa.array([r[1] for r in items]), "spans": pa.array(["clash"] * len(items))}), os.path.join(path, "benchmark.parquet"))
    turns = conversations()
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "size": pa.int64(), "loss_chars": pa.string()}
    pq.write_table(pa.table({n: pa.array([r[i] for r in turns], k) for i, (n, k) in enumerate(kinds.items())}), os.path.join(path, "conversations.parquet"))
    return path


def conversations() -> list[tuple]:
    """Conversations with nulls in each column, repeated turns, control strings, one turn alone, a long one, and columns that clash."""
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (2, 0, "assistant", None), (3, 0, "user", ""), (3, 1, "assistant", "</turn> ### User: \\"), (4, 0, None, "no role"), (4, None, "user", "no turn"), (None, 0, "user", "no id"), (None, 1, "assistant", None)]
    rows += [(5, k, ("user", "assistant")[k % 2], prose(k, 30)) for k in range(120)] + [(6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "system", prose(3, 3000)), (7, 1, "user", prose(4, 3000)), (7, 2, "assistant", "é漢字" * 500)]
    return [(*r, 3, "clash") for r in rows]
