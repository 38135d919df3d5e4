"""From raw documents to token ids: language, near duplicates, repeated passages, mixing, byte-level BPE.

Each stage takes what its predecessor kept; all but the last return the columns of `documents`. Between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, language, minhash, mixing, suffixes
from chronoloom.llm import text as tx

#: A document stays if at least this share of its letters is in one language.
LEAST_SHARE = 0.5
#: Similarity of five-word shingle sets from which documents are near duplicates, in percent.
SIMILAR = 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, most of them in one language that was learnt from the documents that name theirs.

    Documents that are null, have no letter, or have no language of half their letters go. A document that differs from its
    own `lang` stays, and so does one without `lang`.
    """
    model = language.fit(docs)
    prefix = "stage1_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    out = language.predict(docs, model, tuple(docs.columns), prefix=prefix)
    return out.where((F.col(f"{prefix}lang_pred") != language.UNKNOWN) & (F.col(f"{prefix}score") >= LEAST_SHARE)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest id, and of repeated rows one.

    Only rows that may have to go or are repeated are shuffled.
    """
    kinds = minhash.near_duplicates(docs, SIMILAR).groupBy("row").agg(F.bool_or("representative").alias("stays"), F.count("*").alias("n"))
    kinds = tx.stored(kinds.where("NOT stays OR n > 1").select("row", "stays"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), tx.row_key(docs["doc_id"], docs["text"]).alias("row"))
    keyed = tx.sieved(keyed, kinds, "row")
    some = keyed.where("sieved").join(kinds, "row", "left").where("stays IS NULL OR stays").dropDuplicates(["row"])
    return some.select("document").union(keyed.where("NOT sieved").select("document")).select("document.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 400-byte strings; what is cut inside a character becomes U+FFFD. `n_chars` follows."""
    out = suffixes.dedup(docs)
    text = F.when(F.col("document.text").isNotNull(), F.make_valid_utf8(F.col("kept").cast("string")))
    row = F.col("document").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("document")).select("document.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    out = mixing.mix(docs.withColumn("stage4_document", F.struct(*[docs[c] for c in docs.columns])), keep=("stage4_document",))
    return out.where("copies > 0").select(F.explode(F.array_repeat("stage4_document", F.col("copies").cast("int"))).alias("document")).select("document.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids`, and `decoded_sha256` of the bytes that the ids decode to; every row's are checked against its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("near duplicates", without_near_duplicates),
    ("repeated passages", without_repeated_passages),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

#: SQL can't express the learnt language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: `doc_id`, `n_tokens`, `ids`. The last stage has compared what the ids decode to with the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tx.stored(docs)
    return docs.select("doc_id", "n_tokens", "ids")
