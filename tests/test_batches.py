"""Whole-document array work against joins and plain walks, on graphs of all sizes."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.functions import batches as bt
from chronoloom.operators import dismantle, graphs


def random_graphs(spark, sizes, seed=1, back=False):
    rng = random.Random(seed)
    nodes = [(d, 3 * v) for d, n in enumerate(sizes) for v in range(1, n + 1)]
    edges = set()
    for d, n in enumerate(sizes):
        for v in range(1, n + 1):
            for w in range(max(1, v - 5) if back else v + 1, min(n, v + 5) + 1):
                if w != v and rng.random() < 0.35:
                    edges.add((d, 3 * v, 3 * w))
            if n > 20 and rng.random() < 0.1:
                edges.add((d, 3 * v, 3 * rng.randint(1, n)) if back else (d, 3 * v, 3 * n) if v < n else (d, 3, 6))
    return spark.createDataFrame(nodes, "doc_id long, event_no long").repartition(3), spark.createDataFrame(sorted(edges), "doc_id long, i long, j long").repartition(3)


SIZES = [1, 2, 3, 9, 30, 63, 64, 65, 130, 300]


def rounded(df, places=9):
    return Counter(tuple(round(x, places) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("back", [False, True])
def test_features_by_bits_equal_joins(spark, back):
    nodes, edges = random_graphs(spark, SIZES, back=back)
    columns = [*graphs.FEATURES, "degree"]
    want = graphs.features_by_joins(nodes, edges).select("doc_id", "event_no", *columns)
    assert rounded(graphs.raw_features(nodes, edges, columns)) == rounded(want)
    scaled = graphs.minmax_by_doc(want, graphs.FEATURES).select("doc_id", "event_no", *graphs.FEATURES)
    assert rounded(graphs.node_features(nodes, edges)) == rounded(scaled)


def test_large_documents_go_by_joins(spark, monkeypatch):
    nodes, edges = random_graphs(spark, SIZES)
    key = ["doc_id", "event_no"]
    c0 = nodes.selectExpr("doc_id", "event_no", "CASE WHEN event_no % 4 = 1 THEN 0.5D WHEN event_no % 5 = 0 THEN 1D ELSE 0D END AS c0")
    want = [rounded(graphs.node_features(nodes, edges)), rounded(dismantle.neighbor_propagation(edges, c0).select(*key, "s_nd", "degree", "reach_local_proxy"))]
    monkeypatch.setattr(graphs, "BIT_EVENTS", 60)
    monkeypatch.setattr(graphs, "GATHERED", 64)
    small, large = graphs.by_size(nodes, edges)
    assert large.select("doc_id").distinct().count() == 5 and small.select("doc_id").distinct().count() == 5
    assert [rounded(graphs.node_features(nodes, edges)), rounded(dismantle.neighbor_propagation(edges, c0).select(*key, "s_nd", "degree", "reach_local_proxy"))] == want


def test_features_of_odd_tables(spark):
    nodes = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "doc_id long, event_no long")
    edges = spark.createDataFrame([(1, 5, 7), (1, 7, 9), (3, 1, 2), (1, 5, 5)], "doc_id long, i long, j long")  # an event and a document that are no nodes, a loop
    columns = [*graphs.FEATURES, "degree"]
    assert rounded(graphs.raw_features(nodes, edges, columns)) == rounded(graphs.features_by_joins(nodes, edges).select("doc_id", "event_no", *columns))
    assert graphs.node_features(nodes.limit(0), edges.limit(0)).count() == 0
    assert graphs.node_features(nodes, edges.limit(0)).count() == 3


def test_batches_are_cut_between_documents(spark):
    """Documents of one row and of many batches, in pieces of any size."""
    rows = [(d, i) for d, n in enumerate([1, 7, 300, 1, 2, 50]) for i in range(n)] + [(None, 4), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, i long").repartition(4)

    def work(table):
        doc = table.column("doc_id").to_pylist()
        return pa.table({"doc_id": pa.array(list(dict.fromkeys(doc)), pa.int64()), "n": pa.array([doc.count(d) for d in dict.fromkeys(doc)], pa.int64()), "ordered": pa.array([table.column("i").to_pylist() == sorted(table.column("i").to_pylist()) or len(set(doc)) > 1] * len(set(doc)))})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        for together in (1, 20, 1000):
            got = bt.whole_documents(df, work, "doc_id long, n long, ordered boolean", ("i",), together=together).collect()
            assert {(r.doc_id, r.n) for r in got} == {(0, 1), (1, 7), (2, 300), (3, 1), (4, 2), (5, 50), (None, 2)} and len(got) == 7 and all(r.ordered for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segments():
    values, keys = np.array([[1.0, 2], [3, 4], [5, 6]]), np.array([2, 0, 2])
    assert bt.segment_sum(values, keys, 4).tolist() == [[3, 4], [0, 0], [6, 8], [0, 0]]
    assert bt.segment_max(values[:, 0], keys, 3).tolist() == [3, -np.inf, 5]
    assert bt.segment_sum(values[:0], keys[:0], 2).tolist() == [[0, 0], [0, 0]]


def walked(edges):
    """All pairs with a path, by walks."""
    after = {}
    for d, i, j in edges:
        after.setdefault((d, i), set()).add(j)
    out = set()
    for d, i in after:
        seen, todo = set(), [i]
        while todo:
            for w in after.get((d, todo.pop()), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        out |= {(d, i, w) for w in seen - {i}}
    return out


@pytest.mark.parametrize("back", [False, True])
def test_closure_routes_agree(spark, back, monkeypatch):
    _, edges = random_graphs(spark, [2, 3, 9, 30, 64, 65, 90], seed=3, back=back)
    edges = edges.union(edges.limit(5))  # repeated rows
    rows = {tuple(r) for r in edges.collect()}
    pairs = walked(rows)
    assert Counter(map(tuple, graphs.reachable_pairs(edges).collect())) == Counter(pairs)
    assert Counter(map(tuple, graphs.reachable_pairs_by_joins(edges).collect())) == Counter(pairs)
    other = {(d, i, j) for d, i, j in rows if any((d, x, j) in pairs for e, a, x in rows if (e, a) == (d, i) and x != j)}
    assert Counter(map(tuple, graphs.implied_edges(edges).collect())) == Counter(other)
    monkeypatch.setattr(graphs, "CLOSURE_EVENTS", 40)
    assert graphs._by_edges(edges, 40)[1].select("doc_id").distinct().count() == 3
    assert Counter(map(tuple, graphs.reachable_pairs(edges).collect())) == Counter(pairs)
    assert Counter(map(tuple, graphs.implied_edges(edges).collect())) == Counter(other)


def test_closure_of_a_document_of_many_events(spark):
    """20,000 events beside small documents: a ladder, of which each event reaches one in two of those behind it, within each chain of 100."""
    n = 20_000
    edges = spark.range(1, n - 1).selectExpr("7L AS doc_id", "id AS i", "id + 2 AS j").where("(i - 1) div 100 = (j - 1) div 100").union(spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "doc_id long, i long, j long"))
    pairs = graphs.reachable_pairs(edges).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in pairs} == {7: n // 100 * 2 * (50 * 49 // 2), 1: 3}


@pytest.mark.parametrize("back", [False, True])
def test_components_routes_agree(spark, back, monkeypatch):
    nodes, edges = random_graphs(spark, [1, 2, 3, 9, 30, 64, 200], seed=5, back=back)
    edges = edges.where("(i + j) % 4 < 2")
    want = {}
    both = [(d, *e) for d, i, j in (tuple(r) for r in edges.collect()) for e in ((i, j), (j, i))]
    reach = walked(both)
    near = {}
    for d, i, j in reach:
        near.setdefault((d, i), []).append(j)
    for d, v in (tuple(r) for r in nodes.collect()):
        want[d, v] = min([v, *near.get((d, v), [])])
    whole = {d: len({c for (e, _), c in want.items() if e == d}) == 1 for d, _ in want}
    want = Counter((d, v, c, whole[d]) for (d, v), c in want.items())
    assert Counter(map(tuple, graphs.connected_components(nodes, edges).collect())) == want
    assert Counter(map(tuple, graphs.components_by_joins(nodes, edges).select("doc_id", "event_no", "component", "all_connected").collect())) == want
    monkeypatch.setattr(graphs, "COMPONENT_ROWS", 40)
    assert Counter(map(tuple, graphs.connected_components(nodes, edges).collect())) == want


def test_insertion_into_a_document_of_many_events(spark):
    """5,000 events: links of a chain in any order, then what they imply, which isn't added."""
    n = 5000
    rng = random.Random(2)
    order = list(range(1, n))
    rng.shuffle(order)
    llm = spark.createDataFrame([(1, v, v + 1, k) for k, v in enumerate(order)] + [(1, v, v + 7, n + v) for v in range(1, n - 7)] + [(2, 3, 4, 1), (2, 4, 3, 2)], "doc_id long, i long, j long, priority long")
    none = llm.limit(0).select("doc_id", "i", "j")
    sims = none.selectExpr("*", "0D AS sim")
    got = Counter((r.doc_id, r.i, r.j) for r in graphs.add_temporal_edges(none, llm, sims, sims).collect())
    assert got == Counter([(1, v, v + 1) for v in range(1, n)] + [(2, 3, 4)])


def test_similar_pairs_of_large_documents(spark, monkeypatch):
    """In blocks of few events, so that documents are several; with and without a bound; against numpy."""
    monkeypatch.setattr(graphs, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(d, v, (rng.normal(size=20) + (3 if v % 9 == 0 else 0)).tolist()) for d, n in ((1, 5), (2, 40), (3, 1), (4, 15)) for v in range(1, n + 1)] + [(4, 16, [0.0] * 20), (5, 1, [0.0] * 20), (5, 2, [1.0] * 20)]
    vectors = spark.createDataFrame(rows, "doc_id long, event_no long, embedding array<double>").repartition(4)
    want = {}
    for d, i, x in rows:
        for e, j, y in rows:
            if d == e and i < j:
                size = np.linalg.norm(x) * np.linalg.norm(y)
                want[d, i, j] = np.dot(x, y) / size if size else 0.0
    got = {(r.doc_id, r.i, r.j): r.sim for r in graphs.pair_similarity(vectors).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    some = {(r.doc_id, r.i, r.j) for r in graphs.pair_similarity(vectors, 0.6).collect()}
    assert some == {k for k, s in want.items() if s >= 0.6} and 5 < len(some) < len(want) / 2
    assert Counter(map(tuple, graphs.similar_pairs(vectors, 0.6).collect())) == Counter(map(tuple, graphs.similarity_candidates(graphs.pair_similarity(vectors), 0.6).collect()))
    assert graphs.pair_similarity(vectors.limit(0)).count() == 0


def test_blocks_below_the_bound_are_left_out():
    a, b = np.eye(40)[20:23], np.eye(40)[30:34]
    assert graphs._products(a, b, 0.5) is not None  # their tails may agree
    a, b = np.eye(40)[:3], np.eye(40)[4:8]
    assert graphs._products(a, b, 0.5) is None and graphs._products(a, a, 1.0) is not None


def test_kendall_tau_by_inversions(spark):
    from chronoloom.operators import evaluate

    rng = random.Random(6)
    rows = [(d, v, rng.choice([None, 0.1, 0.2, 0.5, rng.random()]), rng.choice([None, 0.0, 1.0, rng.random()])) for d in range(30) for v in range(rng.choice([1, 2, 3, 40]))] + [(99, 1, None, None)]
    sign = lambda x: (x > 0) - (x < 0)
    want = {}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d and r[2] is not None and r[3] is not None]
        pairs = [sign(a[2] - b[2]) * sign(a[3] - b[3]) for k, a in enumerate(own) for b in own[:k]]
        want[d] = sum(pairs) / len(pairs) if pairs else 0
    got = {r.doc_id: r.tau for r in evaluate.kendall_tau(spark.createDataFrame(rows, "doc_id long, event_no long, score double, label double")).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_sums_of_views_in_blocks(spark, monkeypatch):
    from chronoloom.operators import evaluate

    monkeypatch.setattr(evaluate, "BLOCK_NUMBERS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6))
    rows = spark.createDataFrame([(v.tolist(), (2 * v).tolist()) for v in x], "v0 array<double>, v1 array<double>").repartition(9)
    found = evaluate._view_sums(rows, ["v0", "v1"]).toPandas()
    product = found[found["what"] == "product v1"].sort_values("block")
    assert len(product) > 1 and product["n"].eq(50).all()
    assert np.concatenate([np.frombuffer(b) for b in product["x"]]).reshape(6, 6) == pytest.approx(4 * x.T @ x)


def test_rarity_routes_agree(spark, monkeypatch):
    from chronoloom.operators import scoring

    rng = np.random.default_rng(7)
    rows = [(d, v, rng.normal(size=6).tolist()) for d, n in ((1, 1), (2, 2), (3, 40), (4, 9)) for v in range(1, n + 1)] + [(4, 10, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "doc_id long, event_no long, embedding array<double>").repartition(3)
    want = {}
    for d, v, x in rows:
        near = [np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) or 1) for e, w, y in rows if e == d and w != v]
        want[d, v] = float(np.mean([1 - c for c in near])) if near else 0.0
    for most in (scoring.RARITY_EVENTS, 5):
        monkeypatch.setattr(scoring, "RARITY_EVENTS", most)
        got = {(r.doc_id, r.event_no): r.rare for r in scoring.rarity(vectors).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert scoring.rarity(vectors.limit(0)).count() == 0


def test_documents_are_dealt_after_a_join_by_document(spark):
    """The exchange of a join may be read in pieces by adaptive execution, so it doesn't stand in for that of whole documents."""
    a, b = (spark.range(100).selectExpr("id AS doc_id", f"id AS {c}") for c in ("x", "y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = bt.whole_documents(a.join(b, "doc_id"), lambda table: table.select(["doc_id"]), "doc_id long")
        assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
