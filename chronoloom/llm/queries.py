"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprint, language, licenses, manifest, minhash, mixing, quality, runs, suffixes, tokens
from . import text as tx


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", held.alias("held_out"))
    model = language.fit(docs.where("doc_id IS NOT NULL AND NOT held_out"))
    out = language.predict(docs, model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("notices").alias("n_notices"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(table.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), tx.shared_folder(spark))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "document.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("spans").isNotNull().alias("has_repeats"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a tenth of the documents begins to repeat, and by how many words."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    a = h // 10 % n
    return (a, 1 + (n - a) // (3 + h // 10 % 8)) if h % 10 == 0 else None


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_documents(spark, sf_dir), _periodic_tail)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(_documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_language, op3_fingerprint, op4_licenses, op5_chat, op6_token_counts, op7_suffixes, op8_bpe, op9_mixing, op10_minhash, op11_decontaminate, op12_runs, op13_manifest)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.ORACLE_SQL, "op10_minhash": minhash.ORACLE_SQL, "op11_decontaminate": decontaminate.ORACLE_SQL, "op13_manifest": manifest.ORACLE_SQL}
