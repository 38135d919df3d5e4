"""The Merkle manifest against a plain recursive one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import manifest, queries
from tests.conftest import SMALL
from tests.llm import fixtures


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """The root, and for each node the steps (others before, others after) up to it."""
    paths, above = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(paths)):
            own = above[i]
            run = nodes[own - own % 3 : own - own % 3 + 3]
            paths[i].append((run[: own % 3], run[own % 3 + 1 :]))
            above[i] = own // 3
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        found[s] = plain_tree([x[2] for x in groups[s]])
    root, tops = plain_tree([found[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, _, leaf, r), path in zip(groups[s], found[s][1], strict=True):
            steps = path + tops[k]
            odd = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2
            own = leaf if odd or r["text"] is None else plain_leaf(r, r["text"].replace("\n", ""))
            for before, after in steps:
                own = H(*before, own, *after)
            out.append((r["doc_id"], leaf, found[s][0], root, H(*[d for a, b in steps for d in a + b]), own, own == root))
    return Counter(out)


NAMES = [c.split()[0] for c in fixtures.SCHEMA.split(", ")]


def got(spark, rows, most=manifest.HEIGHTS):
    docs = fixtures.odd(spark, rows)
    return Counter(tuple(r) for r in manifest.verify(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, most).collect())


def test_manifest_odd_rows(spark):
    rows = [*fixtures.odd_rows(), (11, "a\nb", "en", "src0", None, 7, "clash", "clash", 5), (14, "a\nb", None, "漢字", 3, 7, "clash", "clash", 5)]
    assert got(spark, rows) == plain_manifest([dict(zip(NAMES, r, strict=True)) for r in rows])


@pytest.mark.parametrize("most", [1, 2])
def test_manifest_many_rounds(spark, most):
    """Small blocks, so that trees take several rounds up and down; one source holds most rows."""
    rng = random.Random(most)
    rows = [(i, rng.choice([None, "", "a\nb", f"text {i}\n"]), "en", rng.choice(["big"] * 6 + [None, "", "b", "c", "d"] + [f"s{i}"]), i, 0, "", "", 0) for i in range(160)]
    assert got(spark, rows, most) == plain_manifest([dict(zip(NAMES, r, strict=True)) for r in rows])


def test_manifest_few_rows(spark):
    assert manifest.verify(fixtures.empty(spark)).count() == 0
    row = (5, "alone", None, None, 5, 0, "", "", 0)
    (only,) = manifest.verify(fixtures.odd(spark, [row])).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.verified and only.proof_sha256 == H()
    rows = [row, (6, "other source", None, "x", 5, 0, "", "", 0)]
    assert got(spark, rows) == plain_manifest([dict(zip(NAMES, r, strict=True)) for r in rows])


def test_manifest_generated_rows_and_sql(spark):
    want = plain_manifest(pq.read_table(f"{SMALL}/documents.parquet").to_pylist())
    assert Counter(tuple(r) for r in queries.op13_manifest(spark, SMALL).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    assert Counter(con.execute(manifest.ORACLE_SQL).fetchall()) == want
