"""Queries against their SQL, hand-worked graphs, and round trips of readers and writers."""

import json
import math
import os
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronoloom.operators import dismantle, evaluate, graphs, incremental, scoring, splits
from chronoloom.operators import documents as prep
from chronoloom.operators.llm_json import first_jsons
from chronoloom.plans import catalog, fixtures
from chronoloom.sources import files
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "events", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    found = tables.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(1, i, f"E{i}") for i in range(1, n + 1)], "doc_id long, event_no long, event_id string")
    return nodes, spark.createDataFrame([(1, i, j) for i, j in edges], "doc_id long, i long, j long")


def plain_sets(n, edges, theta=0.5):
    def pairs(gone):
        succ = {i: {b for a, b in edges if a == i and b not in gone} for i in range(1, n + 1) if i not in gone}
        total = 0
        for s in succ:
            seen, todo = set(), [s]
            while todo:
                for t in succ[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            total += len(seen - {s})
        return total

    r = pairs(())
    if not r:
        return [()]
    target = -(-r * theta // 1)
    for k in range(1, n + 1):
        if hits := [c for c in combinations(range(1, n + 1), k) if pairs(c) <= target]:
            return hits
    return []


@pytest.mark.parametrize(("n", "edges"), [(4, [(1, 2), (2, 3), (3, 4)]), (4, [(1, 2), (1, 3), (2, 4), (3, 4)]), (3, []), (3, [(1, 2), (2, 1), (2, 3)]), (7, [(1, 2), (2, 3), (4, 5), (5, 6), (3, 7), (6, 7), (1, 5)])])
def test_minimal_removal_sets(spark, n, edges):
    nodes, table = graph(spark, n, edges)
    rows = dismantle.minimal_removal_sets(nodes, table).orderBy("set_no").collect()
    assert [tuple(r.members) for r in rows] == plain_sets(n, edges)


def test_equal_graphs_are_searched_once(spark, tmp_path, monkeypatch):
    """Documents whose graphs differ in the events' numbers alone share one search, and each has its own events in its sets."""
    search, log = dismantle.branch, str(tmp_path / "log")

    def logged(*args):
        with open(log, "a") as out:
            out.write("x\n")
        return search(*args)

    monkeypatch.setattr(dismantle, "branch", logged)
    edges = [(1, 2), (2, 3), (3, 4), (4, 5)]
    number = lambda d, v: v * (d + 1) + 7 * d
    nodes = spark.createDataFrame([(d, number(d, v)) for d in range(30) for v in range(1, 6)], "doc_id long, event_no long")
    table = spark.createDataFrame([(d, number(d, a), number(d, b)) for d in range(30) for a, b in edges], "doc_id long, i long, j long")
    rows = dismantle.minimal_removal_sets(nodes, table).orderBy("doc_id", "set_no").collect()
    want = plain_sets(5, edges)
    assert [(r.doc_id, r.set_no, r.members) for r in rows] == [(d, k, [number(d, v) for v in c]) for d in range(30) for k, c in enumerate(want)]
    assert len(open(log).readlines()) == sum(5 - k + 1 for k in range(1, len(want[0]) + 1))


def test_branches_find_all_sets():
    """Against all combinations, of graphs with edges both ways, for targets that take one event to five."""
    draw = random.Random(12)
    for case in range(40):
        n = draw.randint(3, 9)
        succ = np.array([sum(1 << w for w in range(n) if w != v and (w > v or case % 4 == 0) and draw.random() < 0.35) for v in range(n)], np.uint64)
        total = int(dismantle.remaining_pairs(succ, np.zeros(1, np.uint64))[0])
        for k in range(1, min(5, n) + 1):
            target = int(total * draw.random() * 0.7)
            every = list(combinations(range(n), k))
            left = dismantle.remaining_pairs(succ, np.array([sum(1 << v for v in c) for c in every], np.uint64))
            want = [(sum(1 << v for v in c), int(x)) for c, x in zip(every, left, strict=True) if x <= target]
            assert sorted(r for first in range(n - k + 1) for r in dismantle.branch(succ, k, first, target)[0]) == sorted(want)


def test_bound_leaves_most_sets_out():
    """30 events of which five have to go: a tenth of all sets at most is looked at."""
    draw = random.Random(5)
    succ = np.array([sum(1 << w for w in range(v + 1, min(30, v + 7)) if draw.random() < 0.7) for v in range(30)], np.uint64)
    total = int(dismantle.remaining_pairs(succ, np.zeros(1, np.uint64))[0])
    for k in range(1, 6):
        found = [dismantle.branch(succ, k, first, -(-total // 3)) for first in range(30 - k + 1)]
        if any(sets for sets, _ in found):
            break
    assert k == 5 and sum(tried for _, tried in found) < math.comb(30, 5) / 10


def joined(edges, s, t):
    seen, todo = {s}, [s]
    while todo:
        v = todo.pop()
        new = {b for a, b in edges if a == v} - seen
        seen |= new
        todo += new
    return t in seen


def test_greedy_removal_takes_the_best_event_each_time(spark):
    edges = [(1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (4, 7), (6, 7), (7, 8)]
    nodes, table = graph(spark, 8, edges)
    pairs = lambda gone: sum(joined([e for e in edges if not gone & {*e}], s, t) for s in range(1, 9) for t in range(1, 9) if s != t and not gone & {s, t})
    gone, steps, total = set(), [], pairs(set())
    while pairs(gone) > -(-total // 2):
        best = min((v for v in range(1, 9) if v not in gone), key=lambda v: (pairs(gone | {v}), v))
        gone.add(best)
        steps.append((1, len(gone), best, pairs(gone)))
    assert [tuple(r) for r in dismantle.greedy_removal(nodes, table).orderBy("step").collect()] == steps


@pytest.mark.parametrize(("n", "back", "words"), [(100, (), None), (100, (), 500), (70, ((69, 40), (5, 2)), None), (64, (), None), (65, (), None)])
def test_greedy_removal_of_graphs_of_many_events(n, back, words, monkeypatch):
    if words:
        monkeypatch.setattr(dismantle, "BLOCK_WORDS", words)
    draw = random.Random(n)
    edges = [(i, j) for i in range(1, n + 1) for j in range(i + 1, min(n, i + 3) + 1) if draw.random() < 0.6] + list(back)

    def pairs(gone):
        total = 0
        succ = {v: [] for v in range(1, n + 1)}
        for a, b in edges:
            if a not in gone and b not in gone:
                succ[a].append(b)
        for s in succ:
            seen, todo = {s}, [s]
            while todo:
                new = set(succ[todo.pop()]) - seen
                seen |= new
                todo += new
            total += len(seen) - 1
        return total

    gone, steps, total = set(), [], pairs(set())
    while (steps[-1][3] if steps else total) > -(-total // 2):
        best = min((v for v in range(1, n + 1) if v not in gone), key=lambda v: (pairs(gone | {v}), v))
        gone.add(best)
        steps.append((7, len(gone), best, pairs(gone)))
    assert steps
    rows = pd.DataFrame([(7, list(range(1, n + 1)), [{"i": i, "j": j} for i, j in edges])], columns=["doc_id", "ids", "pairs"])
    assert dismantle._greedy(rows, 0.5) == steps


def test_greedy_removal_leaves_no_document_out(spark):
    nodes, table = graph(spark, 100, [(i, i + 1) for i in range(1, 100)])
    rows = dismantle.greedy_removal(nodes, table).collect()
    assert [(r.step, r.event_no, r.pairs_left) for r in rows] == [(1, 50, 49 * 48 // 2 + 50 * 49 // 2)]


@pytest.fixture(scope="module")
def proposals():
    """Random causal edges, expert edges with priorities, similarities of all pairs, by document."""
    rng = random.Random(7)
    docs = {}
    for doc in range(1, 13):
        n = rng.randint(2, 9)
        every = list(combinations(range(1, n + 1), 2))
        pick = lambda share, every=every: [p for p in every if rng.random() < share]
        docs[doc] = n, pick(0.2), [(*p, rng.randint(1, 2)) for p in pick(0.3)], {p: rng.randint(0, 100) / 100 for p in every}
    return docs


def proposed(spark, docs):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    causal = table([(d, i, j) for d, (_, c, _, _) in docs.items() for i, j in c], "doc_id long, i long, j long")
    llm = table([(d, i, j, p) for d, (_, _, e, _) in docs.items() for i, j, p in e], "doc_id long, i long, j long, priority long")
    sims = table([(d, i, j, s) for d, (_, _, _, sims) in docs.items() for (i, j), s in sims.items()], "doc_id long, i long, j long, sim double")
    return causal, llm, graphs.similarity_candidates(sims), sims


def inserted(docs):
    out = {}
    for d, (_, causal, llm, sims) in docs.items():
        have, kept = list(causal), []
        order = [(1, p, -sims[i, j], j - i, i, j) for i, j, p in llm] + [(2, 0, -s, j - i, i, j) for (i, j), s in sims.items() if s >= 0.7]
        for kind, _, sim, _, i, j in sorted(order):
            if not joined(have, i, j) and not joined(have, j, i):
                have.append((i, j))
                kept.append((i, j, "llm" if kind == 1 else "similarity", round(-sim, 4)))
        out[d] = kept
    return out


def test_temporal_edges_are_added_in_turn(spark, proposals):
    got = graphs.add_temporal_edges(*proposed(spark, proposals)).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter((d, *e) for d, kept in inserted(proposals).items() for e in kept)


def test_completed_graphs_are_connected_and_reduced(spark, proposals):
    causal, llm, candidates, sims = proposed(spark, proposals)
    nodes = spark.createDataFrame([(d, i, f"E{i}") for d, (n, *_) in proposals.items() for i in range(1, n + 1)], "doc_id long, event_no long, event_id string")
    got = {}
    for r in graphs.complete_temporal(nodes, causal, llm, candidates, sims).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, (n, causes, _, sims) in proposals.items():
        rows, added = got.get(d, []), inserted(proposals)[d]
        whole = {*causes, *((i, j) for i, j, *_ in added)}
        need = {(i, j) for i, j, *_ in added if not any(joined(whole - {(i, j)}, w, j) for a, w in whole - {(i, j)} if a == i)}
        assert {(r.i, r.j) for r in rows if r.source in ("llm", "similarity")} == need
        assert all(r.score == (round(sims[r.i, r.j], 4) if r.source in ("llm", "similarity") else 0) and r.span == r.j - r.i and r.reason for r in rows)
        both = [*causes, *((r.i, r.j) for r in rows)]
        assert all(joined([*both, *((j, i) for i, j in both)], 1, v) for v in range(1, n + 1))


def test_closure_helper_equals_joins(spark):
    _, table = graph(spark, 8, [(1, 2), (2, 5), (5, 8), (3, 4), (4, 3), (7, 8)])
    assert Counter(graphs.reachable_pairs(table).collect()) == Counter(graphs.reachable_pairs_by_joins(table).collect())


def test_reduction_bridges_and_ties(spark):
    nodes, causal = graph(spark, 3, [(1, 2), (2, 3)])
    _, temporal = graph(spark, 3, [(1, 3)])
    assert graphs.transitive_reduction(causal, temporal).count() == 0
    nodes, table = graph(spark, 4, [(1, 2), (3, 4)])
    assert [tuple(r)[1:] for r in graphs.bridge_components(nodes, table).collect()] == [(1, 3)]
    nodes, table = graph(spark, 4, [(3, 4)])
    assert [tuple(r)[1:] for r in graphs.connect_isolated(nodes, table).collect()] == [(1, 2)]
    scores = spark.createDataFrame([(1, 2, "E2", 0.5), (1, 10, "E10", 0.5), (1, 3, "E3", 0.2)], "doc_id long, event_no long, event_id string, score double")
    assert {r.event_id: r["rank"] for r in scoring.competition_rank(scores).collect()} == {"E2": 1, "E10": 1, "E3": 3}
    assert {r.event_id: r["rank"] for r in scoring.unique_rank(scores).collect()} == {"E10": 1, "E2": 2, "E3": 3}


def plain_first_json(text):
    """Python's decoder from each bracket on."""
    decoder = json.JSONDecoder()
    for part in (text, *re.findall(r"```(?:\w+)?\s*(.*?)```", text, re.DOTALL), re.sub(r"<think>.*?</think>", "", text, flags=re.DOTALL)):
        part = part.strip()
        for at in [None, *(m.start() for m in re.finditer(r"[{\[]", part))]:
            try:
                return json.dumps(json.loads(part) if at is None else decoder.raw_decode(part, at)[0], ensure_ascii=False)
            except ValueError:
                pass
    return None


def test_first_json():
    draw = random.Random(9)
    pieces = ["{", "}", "[", "]", '"', "\\", '\\"', ",", ":", "1", '"a"', '"a":', '{"a": [1, "}"]}', "```json\n", "```", "<think>", "</think>", "é", " ", "\n", "null", '"[\\\\"']
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(0, 14))) for _ in range(20000)]
    texts += ['```json\n{"a": 1}\n```', '<think>{bad</think>[1, "}"]', 'prose {"a": "{"} more', "{cut", "", "[" * 50 + "]" * 50, '{"a": "\ud800"}']
    want = [plain_first_json(t) for t in texts]
    assert first_jsons(texts) == want and sum(w is not None for w in want) > 2000
    assert first_jsons([None, "[]", None]) == [None, "[]", None] and first_jsons([]) == []


def test_view_agreement_is_numpys(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 40, 5)) * 0.7
    view = lambda v: spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(v)], "doc_id long, event_no long, embedding array<double>")
    got = evaluate.view_agreement(view(x), view(y)).first()
    cov = [np.cov(v, rowvar=False) for v in (x, y)]
    variance = np.mean([np.maximum(0, 1 - np.sqrt(np.diag(c) + 1e-4)).mean() for c in cov])
    covariance = np.mean([((c**2).sum() - (np.diag(c) ** 2).sum()) / 5 for c in cov])
    invariance = ((x - y) ** 2).mean()
    assert tuple(got) == pytest.approx((invariance, variance, covariance, 25 * invariance + 25 * variance + covariance))


def test_summaries_of_folds_and_seeds(spark):
    rows = [(1, 0, 0.2, 0.5, 0.1, 1, 2, 1, 0, 1, 3), (1, 1, 0.4, 0.7, 0.3, 2, 2, 2, 1, 0, 4), (2, 0, 0.6, 0.9, 0.5, 0, 1, 0, 1, 1, 5)]
    folds = spark.createDataFrame(rows, "seed int, fold int, loss double, f1 double, tau double, hits long, docs long, tp long, fp long, fn long, tn long")
    one = evaluate.fold_summary(folds.where("seed = 1")).first()
    assert tuple(one) == pytest.approx((0.3, 0.1, 0.6, 0.1, 0.2, 0.75, 3, 1, 1, 7))
    both = evaluate.seed_summary(folds).first()
    assert tuple(both) == pytest.approx((2, 0.375, 0.375, 0.35, 0.15, 0.75, 0.15, 3, 2, 2, 12))


def test_layers_are_numpys(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, len(graphs.FEATURES)))
    (w1, b1), (w2, b2) = layers = [(rng.normal(size=(3, x.shape[1])), rng.normal(size=3)), (rng.normal(size=(1, 3)), rng.normal(size=1))]
    table = spark.createDataFrame([(1, i, *row.tolist()) for i, row in enumerate(x)], ["doc_id", "event_no", *graphs.FEATURES])
    got = scoring.mlp_scores(table, [(w.tolist(), b.tolist()) for w, b in layers]).orderBy("event_no").collect()
    y = np.maximum(x @ w1.T + b1, 0) @ w2.T + b2
    assert [r.score for r in got] == pytest.approx(np.where(y >= 0, y, 0.1 * y)[:, 0])


def leaky(v, slope):
    return np.where(v >= 0, v, slope * v)


def test_attention_and_influence_event_by_event(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 3))
    layers = [(rng.normal(size=(2, 2, 3)), rng.normal(size=(2, 4))), (rng.normal(size=(1, 2, 4)), rng.normal(size=(1, 4)))]
    edges = [(0, 1), (2, 1), (1, 3), (0, 3), (4, 3), (3, 4)]
    h = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(x)] + [(2, 0, x[0].tolist())], "doc_id long, event_no long, x array<double>")
    table = spark.createDataFrame([(1, *e) for e in edges] + [(1, 0, 99)], "doc_id long, i long, j long")
    got = {(r.doc_id, r.event_no): r.x for r in scoring.attention_aggregate(h, table, [(w.tolist(), a.tolist()) for w, a in layers]).collect()}
    y = x
    for w, a in layers:
        rows = []
        for node in range(6):
            row = []
            for head in range(len(w)):
                into = [s for s, d in edges if d == node]
                wh = y @ w[head].T
                e = np.array([np.exp(leaky(np.concatenate([wh[s], wh[node]]) @ a[head], 0.2)) for s in into])
                row += list(leaky(sum((p * wh[s] for p, s in zip(e / e.sum() if len(e) else e, into, strict=True)), np.zeros(w.shape[1])), 0.01))
            rows.append(row)
        y = np.array(rows)
    assert all(got[1, i] == pytest.approx(y[i]) for i in range(6)) and got[2, 0] == [0.0, 0.0]
    p, b = [0.4, -0.7, 0.2], 0.3
    score = {r.event_no: r.score for r in scoring.influence_score(h.where("doc_id = 1"), table, p, b).collect()}
    degree = [max(1, sum(i in e for e in edges)) for i in range(6)]
    for i in range(6):
        near = sum((x[s] for s, d in edges if d == i), np.zeros(3))
        n = sum(d == i for _, d in edges)
        assert score[i] == pytest.approx(x[i] @ (near + x[i]) / (n + 1) + degree[i] / (max(degree) + 1e-6) + (x[i] + near) @ p / (degree[i] + 1) + b)


def test_a_document_whose_layers_fail_leaves_the_others(spark):
    h = spark.createDataFrame([(1, 1, [0.5]), (1, 2, [0.5, 0.1]), (2, 1, [0.5]), (2, 2, [0.25])], "doc_id long, event_no long, x array<double>")
    table = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "doc_id long, i long, j long")
    got = {(r.doc_id, r.event_no): r for r in scoring.attention_aggregate(h, table, [([[[1.0]]], [[1.0, 1.0]])]).collect()}
    assert got[1, 1].error and got[1, 1].x is None and got[2, 2].x == pytest.approx([0.5]) and got[2, 2].error is None


def test_relation_attention_event_by_event(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 5))
    made = lambda size, out: {"w": rng.normal(size=(4, size, 2 * out)), "a": rng.normal(size=(4, 2 * out)), "proj": rng.normal(size=(3, 2 * out)), "bias": rng.normal(size=3), "q": rng.normal(size=3), "heads": 2}
    layers = [made(5, 3), made(6, 2)]
    edges = [(0, 1, 0), (2, 1, 0), (1, 0, 1), (1, 2, 1), (3, 1, 2), (0, 1, 2), (1, 3, 3), (4, 1, 3)]
    vectors = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(x)] + [(2, 0, x[0].tolist())], "doc_id long, event_no long, embedding array<double>")
    typed = spark.createDataFrame([(1, *e) for e in edges], "doc_id long, src long, dst long, rel int")
    out = scoring.relation_attention(vectors, typed, [{k: v if k == "heads" else v.tolist() for k, v in layer.items()} for layer in layers]).cache()
    got = {(r.doc_id, r.event_no): r for r in out.collect()}
    assert len(got) == 7
    elu = lambda v: np.where(v > 0, v, np.expm1(np.minimum(v, 0)))
    y = x
    for n, layer in enumerate(layers):
        new, mixes = [], []
        for node in range(6):
            channels = []
            for r in range(4):
                h = (y @ layer["w"][r]).reshape(6, 2, -1)
                into = [s for s, d, k in edges if d == node and k == r]
                channel = h[node].copy()
                for head in range(2):
                    e = [np.exp(min(leaky(np.concatenate([h[s, head], h[node, head]]) @ layer["a"][r], 0.2), 10)) for s in into]
                    channel[head] += sum((p * h[s, head] for p, s in zip(e, into, strict=True)), 0) / (sum(e) + 1e-12)
                channels.append(channel.ravel())
            att = np.exp([elu(layer["proj"] @ c + layer["bias"]) @ layer["q"] for c in channels])
            mixes.append(att / att.sum())
            new.append(mixes[-1] @ np.array(channels))
        y = elu(np.array(new)) if n == 0 else np.array(new).reshape(6, 2, -1).mean(axis=1)
    for i in range(6):
        assert got[1, i].y == pytest.approx(y[i]) and got[1, i].weights == pytest.approx(mixes[i])
    means = {r.rel: r.weight for r in scoring.relation_weights(out).where("doc_id = 1").collect()}
    assert [means[r] for r in range(4)] == pytest.approx(np.mean(mixes, axis=0), abs=1e-6)


def test_edits_of_one_edge_and_reverses_that_make_cycles(spark):
    old = spark.createDataFrame([(1, 1, 2, "causal", "a"), (1, 2, 3, "causal", "b"), (1, 1, 3, "temporal", "c"), (1, 3, 4, "causal", "d"), (1, 5, 6, "causal", "e"), (1, 6, 5, "causal", "f")], "doc_id long, i long, j long, edge_type string, reason string")
    edits = [(1, 1, 3, "reverse", None, None, 1), (1, 3, 4, "reverse", None, None, 1), (1, 5, 6, "reverse", None, None, 1), (1, 1, 2, "delete", None, None, 1), (1, 1, 2, "retype", "temporal", "better", 2), (1, 7, 8, "add", "causal", "x", 1), (1, 7, 8, "add", "causal", "y", 2), (1, 2, 3, "retype", "temporal", " ", 1)]
    table = spark.createDataFrame(edits, "doc_id long, i long, j long, action string, edge_type string, reason string, edit_no int")
    got = sorted(tuple(r)[1:] for r in incremental.apply_review_edits(old, table).collect())
    assert got == [(1, 2, "temporal", "better", True), (1, 3, "temporal", "c", False), (2, 3, "causal", "b", False), (4, 3, "causal", "d", True), (5, 6, "causal", "e", False), (6, 5, "causal", "f", False), (7, 8, "causal", "y", True)]


def test_three_views_add_up(spark):
    rng = np.random.default_rng(4)
    views = [spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(v)], "doc_id long, event_no long, embedding array<double>") for v in rng.normal(size=(3, 12, 4))]
    got = evaluate.three_view_loss(*views).first()
    a, b = (evaluate.view_agreement(*pair).first() for pair in (views[:2], views[1:]))
    assert tuple(got) == pytest.approx((*a, *b, a.loss + 0.5 * b.loss))
    assert evaluate.view_agreement(views[0].limit(0), views[1]).count() == 0


def test_masked_vectors(spark):
    vectors = spark.createDataFrame([(d, 1, [1.0] * 50) for d in range(40)], "doc_id long, event_no long, embedding array<double>")
    once, again, other = (Counter((r.doc_id, *r.embedding) for r in splits.mask_vectors(vectors, 0.25, view=v).collect()) for v in ("a", "a", "b"))
    assert once == again != other
    assert 0.2 < sum(row[1:].count(0.0) for row in once) / 2000 < 0.3
    assert all(x in (0.0, 1.0) for row in once for x in row[1:])


def test_files(spark, tmp_path):
    for name, text in (("D1", json.dumps({"doc_id": "D1", "events": [{"event_id": "E1", "text": "a"}, {"event_id": "", "text": "b"}], "causal_edges": [{"cause": "E1", "effect": "E2", "reason": "r"}], "temporal_edges": None})), ("D2", "{broken")):
        os.makedirs(tmp_path / "graphs" / name)
        (tmp_path / "graphs" / name / "graph.json").write_text(text)
    graphs_ = files.read_event_graphs(spark, str(tmp_path / "graphs")).cache()
    assert graphs_.where("_corrupt_record IS NOT NULL").first().dir_id == "D2"
    assert files.graph_nodes(graphs_).count() == 1 and files.graph_edges(graphs_).count() == 1
    os.makedirs(tmp_path / "texts")
    for name in ("AB12_a.txt", "AB12_b.txt", "nothing.txt"):
        (tmp_path / "texts" / name).write_text("one\ntwo")
    docs, issues = files.read_source_texts(spark, str(tmp_path / "texts"))
    assert [tuple(r) for r in docs.collect()] == [("AB12", "AB12_a.txt", "one\ntwo")] and issues.count() == 2
    scores = spark.createDataFrame([("D1", "E1", 0.5, 1), ("D1", "E2", 0.5, 1)], "doc_id string, event_id string, score double, rank int")
    files.write_document_jsonl(files.score_documents(scores), str(tmp_path / "json" / "D1"))
    os.makedirs(tmp_path / "runs" / "fold_0")
    (tmp_path / "runs" / "fold_0" / "latest_meta.json").write_text('{"epoch": 3, "val_loss": NaN, "train_loss": 0.5}')
    (tmp_path / "runs" / "fold_0" / "history.json").write_text('[{"train_loss": 2.0, "loss_total": 9.0}, {"train_loss": 1.5, "loss_robust": 3.0, "loss_total": NaN}]')
    run = files.run_metrics(spark, str(tmp_path / "runs")).first()
    assert (run.best_epoch, run.train_loss, run.loss_robust) == (3, 0.5, 3.0)
    os.makedirs(tmp_path / "labels")
    (tmp_path / "labels" / "topo_labels.json").write_text('{"doc_id": "D1", "removal_sets": [["E1"], ["E2", "E3"]], "labels": {"E1": 1.0}, "c0_scores": {"E1": 0.5}}')
    assert [tuple(r) for r in files.read_removal_sets(spark, str(tmp_path / "labels")).collect()] == [("D1", 0, ["E1"]), ("D1", 1, ["E2", "E3"])]
    assert files.read_labels(spark, str(tmp_path / "labels")).first().c0_scores == 0.5
    os.makedirs(tmp_path / "done" / "D1")
    (tmp_path / "done" / "D1" / "checkpoint.json").write_text('{"source_hash": "x", "completed_experts": {"0": ["a", "b"]}, "judge_done": true}')
    assert Counter(r.expert for r in files.read_checkpoints(spark, str(tmp_path / "done")).collect()) == {"a": 1, "b": 1}


def test_labels_of_all_events(spark):
    """Against plain slices; a text that fills its last line has no newline after it."""
    nodes = fixtures.Tables(spark, SMALL).nodes.collect()
    texts = {(r.doc_id, r.event_no): f"{r.event_id}: {r.text}" for r in nodes}
    assert any(len(x) % 14 == 0 for x in texts.values())
    want = {k: "\n".join(x[i : i + 14] for i in range(0, len(x), 14)) for k, x in texts.items()}
    assert {(r.doc_id, r.event_no): r.body for r in catalog.queries()["node_label_whole"](spark, SMALL).collect()} == want


def test_paths_lineage_and_candidates_of_all_events(spark, tmp_path):
    """Against a walk along the edges, of every event of a few documents."""
    pq.write_table(pa.table({"doc_id": [3, 8, 14], "text": ["\n".join(f"e {k}" for k in range(n)) for n in (13, 1, 24)]}), tmp_path / "documents.parquet")
    got = {q: Counter(map(tuple, catalog.queries()[q](spark, str(tmp_path)).collect())) for q in ("path_exists", "lineage", "edge_addition_candidates")}
    edges = [tuple(r) for r in fixtures.Tables(spark, str(tmp_path)).edges.select("doc_id", "i", "j").collect()]
    events = [(d, v) for d, n in ((3, 13), (8, 1), (14, 24)) for v in range(1, n + 1)]
    path = {(d, s, t): joined([(i, j) for e, i, j in edges if e == d], s, t) for d, s in events for e, t in events if d == e}
    assert any(found and t - s > 5 for (_, s, t), found in path.items())
    assert got["path_exists"] == Counter((*k, found) for k, found in path.items() if k[1] <= k[2])
    assert got["lineage"] == Counter((d, *ends, side) for (d, s, t), found in path.items() if found for ends, side in (((s, t), "descendant"), ((t, s), "ancestor")))
    free = lambda d, i, j: not path[d, i, j] and (d, j, i) not in edges
    assert got["edge_addition_candidates"] == Counter((d, a, role, b) for d, a, b in path if a != b for role in ("source", "target") if (free(d, b, a) if role == "source" else free(d, a, b)))


def test_history_of_experts(spark):
    """Own results and those of the others, causal and temporal; a document without results of the round before has no history."""
    docs = spark.createDataFrame([(1, "n", "t"), (2, None, None)], "doc_id long, doc_name string, text string")
    nodes = spark.createDataFrame([(1, 1, "E1", 'a "b"'), (1, 2, "E2", "c"), (2, 1, "E1", "x")], "doc_id long, event_no long, event_id string, text string")
    said = [(1, 0, "discourse", "causal", 1, 2, "r"), (1, 0, "discourse", "temporal", 2, 3, "s"), (1, 0, "temporal", "causal", 2, 3, None), (1, 0, "temporal", "causal", 1, 2, "q")]
    results = spark.createDataFrame(said, "doc_id long, round int, expert string, kind string, i long, j long, reason string")
    got = {(r.doc_id, r.expert): r for r in prep.expert_prompts(docs, nodes, None, results).collect()}
    assert len(got) == 8 and all(r.system_prompt.endswith(prep.SCHEMA) for r in got.values())
    own = '{"expert":"discourse","causal_edges":[{"cause":"E1","effect":"E2","reason":"r"}],"temporal_edges":[{"cause":"E2","effect":"E3","reason":"s"}]}'
    other = '{"expert":"temporal","causal_edges":[{"cause":"E1","effect":"E2","reason":"q"},{"cause":"E2","effect":"E3"}]}'
    shown = prep.OWN_HISTORY.replace("{{RESULT}}", own)
    assert prep.HISTORY.replace("{{OWN}}", shown).replace("{{PEERS}}", f'{{"temporal":{other}}}') in got[1, "discourse"].user_prompt
    assert prep.HISTORY.replace("{{OWN}}", "").replace("{{PEERS}}", f'{{"discourse":{own},"temporal":{other}}}') in got[1, "commonsense"].user_prompt
    assert "round before" not in got[2, "discourse"].user_prompt + got[1, "temporal"].user_prompt
    assert '[{"event_id":"E1","text":"a \\"b\\""},{"event_id":"E2","text":"c"}]' in got[1, "temporal"].user_prompt
    later = {r.doc_id: r.user_prompt for r in prep.expert_prompts(docs, nodes, spark.createDataFrame([(1, 1, 2)], "doc_id long, i long, j long")).where("expert = 'discourse'").collect()}
    assert '{"edge1":{"E1":"a \\"b\\"","E2":"c"}}' in later[1] and prep.NO_CANDIDATES in later[2]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prompts_deal_texts_once(spark):
    """Candidates are found by numbers with gaps as well, those of unknown events are left out; texts are dealt once for each table."""
    docs = spark.createDataFrame([(1, "A", "t1"), (2, "B", "t2")], "doc_id long, doc_name string, text string")
    nodes = spark.createDataFrame([(1, n, f"E{n}", f"x{n}") for n in (2, 3, 7, 11)] + [(2, 1, "E1", None)], "doc_id long, event_no long, event_id string, text string")
    pairs = spark.createDataFrame([(1, 7, 11), (1, 2, 3), (1, 2, 3), (1, 2, 4), (1, 3, 11), (2, 1, 5)], "doc_id long, i long, j long")
    said = pairs.where("doc_id = 1 AND j != 4").distinct().selectExpr("doc_id", "0 AS round", "'temporal' AS expert", "'causal' AS kind", "i", "j", "'r' AS reason")
    one, two = prep.expert_prompts(docs, nodes, pairs), prep.expert_prompts(docs, nodes, None, said)
    rows = {(r.doc_id, r.expert): r.user_prompt for r in one.collect()}
    assert '{"edge1":{"E2":"x2","E3":"x3"},"edge2":{"E3":"x3","E11":"x11"},"edge3":{"E7":"x7","E11":"x11"}}' in rows[1, "discourse"]
    assert prep.NO_CANDIDATES in rows[2, "commonsense"] and '{"event_id":"E7","text":"x7"}' in rows[1, "temporal"] and len(rows) == 8
    told = {(r.doc_id, r.expert): r.user_prompt for r in two.collect()}
    assert "Results of the other experts" in told[1, "discourse"] and "Results" not in told[1, "temporal"] and "Results" not in told[2, "discourse"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (prep.expert_prompts(docs, nodes, pairs), prep.expert_prompts(docs, nodes, None, said)):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(k for k, x in enumerate(lines) if "NestedLoopJoin" in x or "CartesianProduct" in x)
            assert not any("Exchange" in x or "Sort " in x for x in lines[:at])  # nothing is dealt or sorted once for each expert
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
