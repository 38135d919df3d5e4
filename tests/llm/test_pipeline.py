"""The pipeline's stages on odd and generated rows, each against what its operator says of the stage's own input."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from chronoloom.llm import bpe, language, minhash, mixing, suffixes
from chronoloom.llm import text as tx
from tests.conftest import SMALL
from tests.llm import fixtures
from tests.llm.test_operators import WORD, plain_removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    first = tx.stored(stages["language"](spark, docs, SMALL))
    assert first.columns == COLUMNS
    model = language.fit(docs)
    want = {r.doc_id for r in language.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in first.collect()} == want and len(want) > 0.9 * docs.count()

    second = tx.stored(stages["near duplicates"](spark, first, SMALL))
    assert second.columns == COLUMNS
    groups = {}
    for r in minhash.near_duplicates(first, 80).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert {r.doc_id for r in second.collect()} == {min(g) for g in groups.values()}

    third = tx.stored(stages["repeated passages"](spark, second, SMALL))
    assert third.columns == COLUMNS
    before = {r.doc_id: r.text.encode() for r in second.collect()}
    ids = sorted(before)
    marks = plain_removed([before[i] for i in ids], suffixes.LENGTH)
    kept = {i: bytes(b for b, m in zip(before[i], mark, strict=True) if not m).decode(errors="replace") for i, mark in zip(ids, marks, strict=True)}
    assert {r.doc_id: r.text for r in third.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in third.collect())

    fourth = tx.stored(stages["mixing"](spark, third, SMALL))
    assert fourth.columns == COLUMNS
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect() if r.copies}
    assert Counter(r.doc_id for r in fourth.collect()) == Counter(copies)
    assert all(WORD.search(r.text) for r in fourth.collect())

    last = stages["byte-level BPE"](spark, fourth, SMALL)
    decoded = bpe.decode(last, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in decoded.collect()) == Counter((r.doc_id, r.text) for r in fourth.collect())


def test_run_and_odd_rows(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 100
    path = fixtures.written(fixtures.odd_rows())
    assert corpus_pipeline.run(spark, path).count() > 20
    docs = fixtures.odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, path)
        assert made.columns == docs.columns, name
        assert stage(spark, fixtures.empty(spark), path).count() == 0, name
    one = corpus_pipeline.without_near_duplicates(spark, docs, path).collect()
    assert len([r for r in one if r.doc_id == 0]) == 1 and len([r for r in one if r.doc_id is not None and 100 <= r.doc_id < 112]) < 12
    assert not any(re.fullmatch(r"[\s\d\W]*", r.text or "") for r in corpus_pipeline.by_language(spark, docs, path).collect())


def test_last_stage_decodes_every_row(spark):
    docs = fixtures.odd(spark)
    rows = corpus_pipeline.encoded(spark, docs, SMALL).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    known = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(hashlib.sha256(known.decode(np.array(r.ids, np.int32), np.array([0, len(r.ids)]))[0]).hexdigest() == r.decoded_sha256 for r in rows)
    text = pa.array(["two words"])
    ids, bounds = known.encode(text)
    with pytest.raises(ValueError, match="differ"):
        known.digests(ids[:-1], bounds - np.array([0, 1]), text)
