"""Token counts with a digest cache.

A text's count depends on its content and on the tokenizer alone, so counts are stored under the digests of both. Counting a
table joins its content digests to the cache, encodes each distinct content that is missing there once, appends these counts,
and joins again. Content is normalised no further than what can't change a count: a null text is as an empty one.

Defined results: an empty or null text has 0 tokens; repeated texts are encoded once and counted each; special strings inside
texts are handled as the library does by default; an empty table appends nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from . import words

#: Words whose counts a worker remembers, about 10 MB, and new words that the library encodes together.
REMEMBERED, TOGETHER = 300_000, 5000
CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])

_loaded: dict[str, Callable[[pa.Array], np.ndarray]] = {}


def tokenizer_digest(path: str) -> str:
    """The digest of a tokenizer's version: its file and the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.encode()).hexdigest()


def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """A function from a column of texts to their numbers of tokens, as the library counts them."""
    if path not in _loaded:
        _loaded[path] = _model_counter(path) if path.endswith(".model") else _json_counter(path)
    return _loaded[path]


def _model_counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda column: np.array([len(x) for x in model.encode([t or "" for t in column.to_pylist()], num_threads=1)], np.int64)


def _json_counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    library = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    whole = lambda column: np.array(library([t or "" for t in column.to_pylist()]), np.int64)
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    form = said.get("pre_tokenizer") or {}
    added = [t["content"].encode() for t in said.get("added_tokens") or []]
    if form.get("type") != "ByteLevel" or not form.get("use_regex", True) or form.get("add_prefix_space") or said.get("normalizer"):
        return whole
    # Each word of a byte-level split is encoded by itself, so the library encodes each distinct word once.
    table = words.Table(REMEMBERED)

    def make(new: list[bytes]) -> list[tuple[int]]:
        return [(n,) for i in range(0, len(new), TOGETHER) for n in library([w.decode() for w in new[i : i + TOGETHER]])]

    def count(column: pa.Array) -> np.ndarray:
        data, offsets = tx.utf8(column)
        starts, bounds = words.split(data, offsets)
        first, _, values = table.look_up(data, starts, make)
        out = np.diff(np.append(0, np.cumsum(values[first], dtype=np.int64))[bounds])
        text = data.tobytes()
        if any(t in text for t in added):  # texts with an added token's string go to the library whole
            rows = [i for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) if any(t in text[a:b] for t in added)]
            out[rows] = whole(column.take(pa.array(rows, pa.int64())))
        return out

    return count


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if nothing was stored."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count(documents: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens` and `over_limit` of every row; new counts are appended to the cache at `cache`.

    Digests are made where the texts are read. Distinct contents are picked by a hash aggregate that collapses copies
    before the one shuffle of texts, so a content that a third of all rows share is no hot key.
    """
    spark = documents.sparkSession
    version = tokenizer_digest(tokenizer)
    content = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", content.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    distinct = rows.select("content", "text").join(stored.select("content"), "content", "left_anti") if stored.head(1) else rows.select("content", "text")
    misses = distinct.groupBy("content").agg(F.first("text").alias("text"))

    def work(part: pa.RecordBatch) -> dict[str, object]:
        return {"n_tokens": counter(tokenizer)(part.column(part.schema.get_field_index("text")))}

    made = tx.map_text(misses, "text", work, [T.StructField("n_tokens", T.LongType())], ["content"])
    made.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
