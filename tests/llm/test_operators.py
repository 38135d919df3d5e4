"""Each dealt operator against a plain version, on odd rows, no rows and the smallest generated tables."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronoloom.llm import bpe, chat, fingerprint, language, licenses, minhash, mixing, quality, queries, suffixes, tokens, words
from chronoloom.llm import text as tx
from tests.conftest import SMALL
from tests.llm import fixtures

DOCS = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(rows):
    """Rows of the odd table and the smallest generated one, as (doc_id, text)."""
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return fixtures.odd(spark).cache()


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# 1 quality


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(marked)


def test_quality_base_counts():
    for _, text in pairs(fixtures.odd_rows()) + [(r["doc_id"], r["text"]) for r in DOCS] + [(0, "a\x1cb\x85c d e \n\n \na b\na b")]:
        assert quality.base_counts(text) == plain_counts(text)


def test_quality_model_learns_and_odd_rows_pass(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    good = [r.quality_probability >= 0.5 for r in rows if r.quality == 1]
    bad = [r.quality_probability >= 0.5 for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2
    assert quality.score(odd, model).count() == len(fixtures.odd_rows())
    assert quality.fit(odd, labels.limit(0)) is None
    plain = quality.score(odd, None).where("doc_id = 304").first()
    assert plain.base_failed and not plain.kept and plain.quality_probability is None
    assert quality.score(fixtures.empty(spark), model).count() == 0


# 2 language


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 5, 3, 0, 7]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(bounds[-1], 3)) * 3
    path = language._paths(scores, bounds, 2.5)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        best = -math.inf
        n = b - a
        for k in range(3**n if n else 0):
            states = [k // 3**i % 3 for i in range(n)]
            best = max(best, sum(scores[a + i, s] for i, s in enumerate(states)) - 2.5 * sum(x != y for x, y in zip(states, states[1:], strict=False)))
        if n:
            own = path[a:b].tolist()
            assert sum(scores[a + i, s] for i, s in enumerate(own)) - 2.5 * sum(x != y for x, y in zip(own, own[1:], strict=False)) == pytest.approx(best)


def test_language_held_out_and_mixed(spark, odd):
    rows = queries.op2_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 100 < len(held) < 400
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    model = language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    by_lang = {}
    for r in DOCS:
        if len(r["text"].split()) > 80:
            by_lang.setdefault(r["lang"], r["text"])
    a, b = (" ".join(by_lang[x].split()[:40]) for x in ("en", "fr"))
    mixed = language.predict(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string"), model).first()
    assert [s.lang for s in mixed.lang_spans] == ["en", "fr"] and 0.3 < mixed.score < 0.8
    got = {r.doc_id: r for r in language.predict(odd, model).where("doc_id in (300, 301, 302, 307)").collect()}
    assert all(r.lang_pred == "und" and r.score == 0 and not r.lang_spans for r in got.values()) and len(got) == 4
    assert language.fit(fixtures.empty(spark)) is None
    assert language.predict(fixtures.empty(spark), None).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def test_very_many_languages():
    scores = np.zeros((6, 300))
    scores[:, 280] = 5
    assert language._paths(scores, np.array([0, 6]), 1.0).tolist() == [280] * 6


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир это просто текст", "ru"), ("γειά σου κόσμε αυτό", "el"), ("hello world this is text", "en")] * 3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = language.predict(spark.createDataFrame([(1, "неизвестные слова"), (2, "άγνωστες λέξεις"), (3, "漢字 – hello")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["ru", "el", "en"]


# 3 fingerprints


def sketches_of(texts):
    data = b"".join(t.encode() for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    return np.frombuffer(data, np.uint8), offsets


def test_fingerprints_do_not_depend_on_the_batch():
    texts = [t or "" for _, t in pairs(fixtures.odd_rows())] + ["aaaaaaa", "ab", "aab", ""]
    together = fingerprint.written(*fingerprint.sketches(*sketches_of(texts)))
    for t, f in zip(texts, together, strict=True):
        assert fingerprint.written(*fingerprint.sketches(*sketches_of([t]))) == [f]


def test_equal_substrings_share_interior_names():
    core = fixtures.prose(5, 400)
    texts = [core, f"{fixtures.prose(6, 37)} {core}", f"{core} {fixtures.prose(7, 11)}"]
    _, names, rows = fingerprint.names(*sketches_of(texts))
    own = [set(names[rows == i].tolist()) for i in range(3)]
    assert len(own[0] & own[1]) > 0.9 * len(own[0]) and len(own[0] & own[2]) > 0.9 * len(own[0])


def test_fingerprint_query_edits_and_likeness(spark):
    rows = sorted(((r["doc_id"], r["text"]) for r in DOCS), reverse=True)
    got = {r.doc_id: r for r in queries.op3_fingerprint(spark, SMALL).collect()}
    assert len(got) == len(rows)
    near = 0
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[j].fingerprint) == (text == after) or got[i].near_next == 1
        near += got[i].near_edited > got[i].near_next
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert near > 0.9 * len(rows)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprint_neighbours_across_ranges(spark, ranges):
    rows = [(i * 3, fixtures.prose(i, i % 7)) for i in range(60)]
    got = {r.doc_id: r for r in fingerprint.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ranges).collect()}
    down = rows[::-1]
    for (i, t), (_, after) in zip(down, down[1:] + down[:1], strict=True):
        k = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        alone = fingerprint.likeness(fingerprint.sketches(*sketches_of([t])), fingerprint.sketches(*sketches_of([after])))[0]
        assert got[i].near_next == pytest.approx(alone)


def test_fingerprint_odd_rows(spark, odd):
    assert fingerprint.compare_edited(odd).count() == len(fixtures.odd_rows())
    assert fingerprint.compare_edited(fixtures.empty(spark)).count() == 0
    one = fingerprint.compare_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1


# 4 licenses


def test_license_base_places(spark, odd):
    rows = pairs(fixtures.odd_rows()) + [(1000 + i, t) for i, t in enumerate(["MIT  license mit-License", "gnu General\nPublic license, apache, License apache license"])]
    got = multiset(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    want = Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want[(i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert got == want
    assert licenses.scan(fixtures.empty(spark)).count() == 0


def test_license_templates(spark):
    said = {
        1: ("Licensed under the Apache License, Version 2.0 (the x", "apache,apache-notice"), 2: ("licensed under the apache license", "apache,apache-notice"), 3: ("licensed under an apache license", "apache"),
        4: ("This is licensed under CC BY-NC 4.0.", "cc-notice"), 5: ("Licensed under Creative Commons CC BY", "cc-notice"), 6: ("licensed under cc nc", ""), 7: ("licensed under the GNU Lesser General Public License version 3", "gpl,gpl-notice"),
        8: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, subject to, to deal in the Software without restriction", "mit-grant"),
        9: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to sell in the Software without restriction", ""),
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in said.items()], "doc_id long, text string")).collect()}
    assert {k: r["labels"] for k, r in got.items()} == {k: v for k, (_, v) in said.items()}
    assert got[1].score == 1 and 0 < got[9].score < 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_license_texts_need_all_their_mandatory_words(spark):
    """Each template's text with its optional parts and some free words is found; without one of its mandatory words it isn't."""
    rng, rows = random.Random(9), []
    for k, (label, template) in enumerate(licenses.TEMPLATES.items()):
        mandatory = re.sub(r"<<any:\d+>>", "", re.sub(r"<<opt>>.*?<</opt>>", "", template.replace("<<opt>><<any:2>><</opt>>", "").replace("<<opt>>version <<any:2>> <</opt>>", "").replace("<<opt>>version <<any:1>><</opt>>", ""))).split()
        full = re.sub(r"<</?opt>>", " ", re.sub(r"<<any:\d+>>", " free ", template)).split()
        gone = rng.randrange(1, len(mandatory) - 1) if len(mandatory) > 2 else 1
        for j, text in enumerate((full, mandatory, mandatory[:gone] + ["qqq"] + mandatory[gone + 1 :])):
            rows.append((k * 3 + j, "Before: " + ", ".join(w.title() for w in text) + ". After.", label))
    got = {r.doc_id: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    for i, _, label in rows:
        assert (label in got[i]) == (i % 3 < 2), (label, i % 3)
    once = licenses.scan(spark.createDataFrame([(1, "It is released under the MIT license.")], "doc_id long, text string")).first()
    assert [n.first_word for n in once.notices if n.label == "mit-notice"] == [2]


# 5 chat


def plain_digests(rows):
    turns = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in rows)
    loss = "".join(text or "" for _, role, text in rows if role == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget", [512, 40])
def test_chat_reads_back(spark, budget):
    rng = random.Random(3)
    bits = ["\\", "###", "#~#", "</turn>", "</turn>\n", ": ", "\n", "word ", "\\h", "#", "<", "</tu", "rn>", "é漢"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 25)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "ro: le ###"]) if turn else rng.choice(["system", "user"])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))])))
    rows += [(None, 1, "user", "x"), (99, None, None, None), (98, 0, "system", "long " * 3000), (98, 1, "assistant", "yes"), (97, 1, "assistant", "tie"), (97, 1, "assistant", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.windows(table, public_tokenizers.path("byte_bpe_50k.json"), budget, 16)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(made).collect()}
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role, text))
    for conv, turns in own.items():
        turns.sort(key=lambda r: (r[0] if r[0] is not None else -1, r[1] or "", r[2] or ""))
        assert got[conv] == plain_digests(turns)
    assert len(got) == len(own)
    for w in made.collect():  # budget, system turn, history
        turns = chat.read_turns(w.text)
        assert w.n_tokens <= budget or sum(mine for mine, _, _ in turns) == 1
        first = own[w.conv_id][0]
        if w.window_no and first[1] == "system":
            assert turns[0] == (False, "system", first[2] or "")
        if w.window_no == 0:
            assert all(mine for mine, _, _ in turns)


def test_chat_query(spark):
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op5_chat(spark, SMALL).collect()}
    own = defaultdict(list)
    for r in pq.read_table(f"{SMALL}/conversations.parquet").to_pylist():
        own[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    said = r"\### Assistant: </turn> ok"
    own[-7] = [(0, "user", said), (1, "assistant", said)]
    assert got == {k: plain_digests(sorted(v)) for k, v in own.items()}
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


# 6 token counts


def test_token_counts_are_the_librarys(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = pairs(fixtures.odd_rows()) + [(2000, "a<|endoftext|><|endoftext|> b"), (2001, "   x \u0085 y᠎٣४ "), (2002, "a" * 3000)]
    cache = tx.shared_folder(spark)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert multiset(tokens.count(table, path, cache).collect()) == want
    size = tokens.read_cache(spark, cache).count()
    assert size == len({t or "" for _, t in rows})
    more = table.union(spark.createDataFrame([(9, "new text here")], "doc_id long, text string"))
    assert tokens.count(more, path, cache).count() == len(rows) + 1
    assert tokens.read_cache(spark, cache).count() == size + 1  # misses alone are encoded and appended
    assert tokens.count(fixtures.empty(spark), path, tx.shared_folder(spark)).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_of_other_files(spark, name):
    path = public_tokenizers.path(name)
    texts = [r["text"] for r in DOCS[:40]] + [t or "" for _, t in pairs(fixtures.odd_rows())]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        from tokenizers import Tokenizer

        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens.counter(path)(pa.array(texts)).tolist() == want


def test_words_are_the_patterns():
    import regex

    pattern, rng = regex.compile(words.PATTERN), random.Random(1)
    bits = ["'", "'s", "'t", "'re", "'ve", "'ll", "s", "e", "ll", " ", "  ", "\n", "\t", "\r\n", "a", "B", "1", "２", "²", "Ⅷ", "é", "漢", "\u0301", "\u00a0", "\u2003", "\x85", "\x1c", "!", "--", "😀", "ع", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + [t or "" for _, t in pairs(fixtures.odd_rows())]
    data, offsets = tx.utf8(pa.array(texts))
    starts, bounds = words.split(data, offsets)
    ends, whole = [*starts[1:].tolist(), len(data)], data.tobytes()
    got = [[whole[a:b].decode() for a, b in zip(starts[i:j].tolist(), ends[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [pattern.findall(t) for t in texts]


def test_word_table_forgets_and_tells_words_apart():
    rng = random.Random(2)
    table = words.Table(50)
    for _ in range(30):
        texts = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(40)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        first, count, values = table.look_up(data, starts, lambda new: [tuple(w) for w in new])
        assert words.gathered(first, count, values).astype(np.uint8).tobytes() == data.tobytes()


def test_sieve_passes_all_keys(spark):
    rows = spark.range(5000).selectExpr("id", "unhex(md5(cast(id AS string))) AS key")
    got = {r.id for r in tx.sieved(rows, rows.where("id % 50 = 0"), "key").where("sieved").collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 400
    assert tx.sieved(rows, rows.limit(0), "key").where("sieved").count() == 0


# 7 suffixes


def plain_removed(texts, length):
    """Marks of covered bytes: strings of `length` bytes that start twice or more anywhere."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(mark)
    return out


def check_removed(spark, rows, hot=None):
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, mark in zip(rows, texts, plain_removed(texts, 400), strict=True):
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        spans = len(re.findall(rb"\x01+", bytes(mark)))
        want[(i, len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest())] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter()
    for r in suffixes.dedup(table).collect():
        got[(r.document.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans or []), hashlib.sha256(bytes(r.kept)).hexdigest())] += 1
    assert got == want


def test_suffixes_remove_what_repeats(spark):
    check_removed(spark, [r for r in pairs(fixtures.odd_rows()) if r[0] != 315])


def test_suffixes_on_generated_rows(spark):
    check_removed(spark, [(r["doc_id"], r["text"]) for r in DOCS])


def test_suffixes_at_the_length(spark):
    a, b, c = ("".join(random.Random(i).choices("abcdé ", k=1200)) for i in (1, 2, 3))
    rows = [(1, b[:300] + a[:400] + c[:200]), (2, c[300:500] + a[:400] + b[300:600]), (3, a[:399] + b[700:]), (4, c[600:1000] + "x" + a[1:400]), (5, "ab" * 700), (6, "ab" * 201), (7, "q" * 400), (8, "q" * 401), (9, c[600:1000])]
    check_removed(spark, rows)
    check_removed(spark, [(1, "z" * 401)])
    check_removed(spark, [(1, "z" * 400)])


@pytest.mark.parametrize("most_hot", [suffixes.MOST_HOT, 0])
def test_suffixes_hot_anchor(spark, monkeypatch, most_hot):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "MOST_HOT", most_hot)
    check_removed(spark, [r for r in pairs(fixtures.odd_rows()) if r[0] not in (315, 306)])


def test_suffixes_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "LONG_TEXT", 700)
    a = fixtures.prose(31, 600)
    check_removed(spark, [(1, a), (2, a[900:1900] + fixtures.prose(32, 50)), (3, fixtures.prose(33, 200) + a[100:600])])


def test_suffixes_empty(spark):
    assert suffixes.dedup(fixtures.empty(spark)).count() == 0
    assert suffixes.dedup(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().n_bytes == 0


def test_multikey_sort():
    rng = np.random.default_rng(2)
    tokens_ = rng.integers(0, 3, size=(500, 4)).astype(np.uint64)
    order, run = suffixes.multikey_sort(tokens_)
    rows = [tuple(x) for x in tokens_[order].tolist()]
    assert rows == sorted(rows)
    assert all((rows[i] == rows[i - 1]) == (run[i] == run[i - 1]) for i in range(1, 500))


# 8 BPE


def test_bpe_is_tiktokens_and_decodes(spark, odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    rows = pairs(fixtures.odd_rows()) + [(3000 + i, "".join(rng.choice("aaabcd eèéx'sß漢\n1") for _ in range(200))) for i in range(50)] + [(r["doc_id"], r["text"]) for r in DOCS[:60]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want, digests = Counter(), Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), tuple(ids))] += 1
        digests[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    made = bpe.encode(table, path, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in made.collect()) == want
    assert Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(made, path, public_tokenizers.PATTERN).collect()) == Counter((i, (t or "").encode()) for i, t in rows)
    assert multiset(bpe.round_trip(table, path, public_tokenizers.PATTERN).collect()) == digests
    assert bpe.encode(fixtures.empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_replay_when_a_smaller_rank_comes_up():
    """Made ranks in which merges produce pairs of smaller rank, against the plain rule: the first smallest pair, one at a time."""
    rng = random.Random(4)
    for _ in range(200):
        made = {bytes([i]): i for i in range(256)}
        some = {bytes(rng.choices(b"ab", k=rng.randint(2, 5))) for _ in range(12)}
        made |= {s: 256 + i for i, s in enumerate(rng.sample(sorted(some), len(some)))}
        texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(20)]
        for text, ids in zip(texts, bpe.Vocabulary(made, "x").replay(texts), strict=True):
            parts = [bytes([x]) for x in text]
            while text not in made and len(parts) > 1:
                r, i = min((made.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if r == 10**9:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert ids == ((made[text],) if text in made else tuple(made[p] for p in parts))


# 9 mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_targets_and_takes(spark, odd):
    for table in (odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        sizes, rows = Counter(), table.select("source", "text").collect()
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        want = plain_targets(sizes)
        out = mixing.mix(table, keep=("source",)).collect()
        assert len(out) == len(rows)
        taken, largest = Counter(), Counter()
        for r in out:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"] if isinstance(r["size"], int) else 0)
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
        again = mixing.mix(table.repartition(3), keep=("source",)).collect()
        assert multiset(again) == multiset(out)
    assert mixing.mix(fixtures.empty(spark)).count() == 0


def test_mixing_with_and_without_a_broadcast(spark, odd, monkeypatch):
    want = multiset(mixing.mix(odd, keep=("source",)).collect())
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert multiset(mixing.mix(odd, keep=("source",)).collect()) == want
    monkeypatch.setattr(mixing, "CUTS", 2)
    assert sum(r.taken for r in mixing.mix(odd).collect()) > 0


def test_mixing_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = Counter(con.execute(mixing.ORACLE_SQL).fetchall())
    assert multiset(queries.op9_mixing(spark, SMALL).collect()) == want


# 10 minhash


def plain_components(rows, percent):
    sets = []
    for _, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("percent", "block"), [(85, 512), (80, 4)])
def test_minhash_components(spark, monkeypatch, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = pairs(fixtures.odd_rows())
    base = fixtures.prose(4000, 150)
    rows += [(5000 + i, fixtures.edited(base, i, 0.012)) for i in range(40)]
    rows += [(6000 + i, " ".join(base.split(" ")[i : i + 100])) for i in range(0, 50, 4)]  # a chain of overlaps
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent)
    assert multiset(got.select("doc_id", "n_shingles", "component_id").collect()) == plain_components(rows, percent)


def test_minhash_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = Counter(con.execute(minhash.ORACLE_SQL).fetchall())
    assert multiset(queries.op10_minhash(spark, SMALL).collect()) == want


def test_minhash_long_text_and_blocks_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LONG_TEXT", 500)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    base = fixtures.prose(70, 400)
    rows = [(i, fixtures.edited(base, i, 0.006 * (i % 3))) for i in range(12)] + [(20, "x" * 3000), (21, "x" * 3000), (22, "a b c " + "y" * 2000), (23, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert multiset(got.select("doc_id", "n_shingles", "component_id").collect()) == plain_components(rows, 85)


def test_minhash_generated_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in DOCS]
    got = queries.op10_minhash(spark, SMALL).collect()
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(9)]
    root = list(range(120))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = minhash.components(spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in links], "a binary, b binary")).collect()
    assert {r.node[0]: r.root[0] for r in got} == {v: find(v) for v in range(120) if find(v) != v} and len(got) == len({r.node[0] for r in got})


def test_minhash_pruning_keeps_links():
    need = minhash.needed(0.85, 120)
    assert all(need[n] <= 0.85 * n for n in range(1, 121)) and need[120] > 60
    assert (1 - 0.85**minhash.ROWS) ** minhash.bands(0.85) <= minhash.MISS


# all queries


def test_queries_on_odd_tables(spark):
    """Nulls in every column, repeated and very long rows, extra columns: each query returns a row for each document, or conversation."""
    path = fixtures.written(fixtures.odd_rows())
    for name, query in queries.queries().items():
        n = len(fixtures.odd_rows()) if name != "op5_chat" else len({r[0] for r in fixtures.conversations()}) + 1
        assert query(spark, path).count() == n, name


def test_chat_of_odd_conversations(spark):
    """Digests of what is read back, against the turns themselves; equal turns keep the order of their texts."""
    path = fixtures.written(fixtures.odd_rows())
    got = {r.conv_id: r for r in queries.op5_chat(spark, path).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in fixtures.conversations():
        turns[conv].append((turn if turn is not None else -(1 << 63), role or "", text or ""))
    for conv, rows in turns.items():
        rows.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        learnt = "".join(text for _, role, text in rows if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest()), conv
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest()), conv


# memory of workers


def test_groups_are_read_a_slice_at_a_time():
    """The sets of a batch of thousands of texts are not all copied at once."""
    n, one = 2000, b"x" * 8000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n), pa.array([b"%d" % i for i in range(n)]), pa.array([one] * n)], names=["label", "block", "class", "shingles"])
    tracemalloc.start()
    try:
        assert [int(x) for group in minhash._in_groups(iter([batch]), 2) for x, _ in group] == list(range(n))
        assert tracemalloc.get_traced_memory()[1] < 5_000_000  # of 16 MB
    finally:
        tracemalloc.stop()


def test_tasks_give_their_memory_back(spark):
    """One worker's memory after a task that needed much, as it is when the next task begins."""

    def large(batches):
        for batch in batches:
            held = [pa.array(np.full(20_000, i)) for i in range(1000)]  # 160 MB
            yield batch
            del held

    def small(batches):
        for batch in batches:
            with open("/proc/self/smaps_rollup") as file:
                used = sum(int(x.split()[1]) for x in file if x.startswith(("Pss_Anon", "Pss_Shmem")))
            yield pa.RecordBatch.from_arrays([pa.array([used] * batch.num_rows, pa.int64())], names=["id"])

    rows = spark.range(1).coalesce(1)
    before = tx.map_arrow(rows, small, "id long").first().id
    assert tx.map_arrow(rows, large, "id long").count() == 1
    assert tx.map_arrow(rows, small, "id long").first().id - before < 60_000  # KB
