"""Event-graph tables that Spark derives from the given tables by integer rules, and the same rules as SQL.

Every table covers all documents: `nodes` are the lines of `documents.text`; edges, proposals, verdicts, vectors, scores and logs
follow from document and event numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import documents as prep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.documents = table(spark, sf_dir, "documents")

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def docs(self) -> DataFrame:
        name = F.concat(F.upper("lang"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("_"), F.col("source"), F.lit(".txt"))
        return self.documents.select("doc_id", "text", name.alias("doc_name"))

    @property
    def nodes(self) -> DataFrame:
        """`doc_id`, `event_no`, `event_id`, `text`: the non-blank lines of each document."""
        return prep.timeline_events(self.documents.select("doc_id", "text"))

    @property
    def sized(self) -> DataFrame:
        """`doc_id`, `n`: documents with events; counted inside the row."""
        lines = F.filter(F.transform(F.split("text", r"\R"), prep.strip), lambda x: x != "")
        return self.documents.select("doc_id", F.size(lines).cast("long").alias("n")).where("n > 0")

    def near(self, width: int) -> DataFrame:
        """`doc_id`, `i`, `j`, `n`: pairs at most `width` apart, made without a join."""
        rows = self.sized.where("n > 1").select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("i"))
        return rows.select("doc_id", "i", F.explode(F.sequence(F.col("i") + 1, F.least("n", F.col("i") + width))).alias("j"), "n")

    @property
    def causal(self) -> DataFrame:
        return self.near(3).where("(11 * doc_id + 5 * i + 3 * j) % 7 = 0").select("doc_id", "i", "j")

    @property
    def temporal(self) -> DataFrame:
        return self.near(2).where("(j = i + 1 AND (doc_id + i) % 4 != 0) OR (j = i + 2 AND (doc_id + 2 * i) % 5 = 0)").select("doc_id", "i", "j")

    @property
    def edges(self) -> DataFrame:
        """Both rules over each pair at once: every pair comes once, so nothing is made distinct."""
        rule = "(11 * doc_id + 5 * i + 3 * j) % 7 = 0 OR (j = i + 1 AND (doc_id + i) % 4 != 0) OR (j = i + 2 AND (doc_id + 2 * i) % 5 = 0)"
        return self.near(3).where(rule).select("doc_id", "i", "j")

    @property
    def proposals(self) -> DataFrame:
        """Clean proposals of round 0."""
        rows = self.near(4).withColumn("expert", F.explode(F.array(F.lit("temporal"), F.lit("precondition"))))
        rows = rows.where("(expert = 'temporal' AND (doc_id + 3 * i + j) % 3 = 0) OR (expert = 'precondition' AND (doc_id + i + 2 * j) % 4 = 0)")
        return rows.select("doc_id", "expert", F.when(F.col("expert") == "temporal", 0).otherwise(1).alias("expert_no"), (F.col("i") * 100000 + F.col("j")).alias("ordinal"), "i", "j", reason().alias("reason"))

    @property
    def raw_proposals(self) -> DataFrame:
        """Proposals with string ids; every tenth document has odd rows as well."""
        text = lambda c: F.concat(F.lit("E"), F.col(c).cast("string"))
        clean = self.proposals.select("doc_id", "expert", "ordinal", text("i").alias("cause"), text("j").alias("effect"), "reason")
        tenth = F.col("doc_id") % 10 == 0
        padded = clean.where(tenth).select("doc_id", "expert", (F.col("ordinal") + 10**9).alias("ordinal"), F.concat(F.lit("  "), F.col("cause")).alias("cause"), F.concat(F.col("effect"), F.lit(" ")).alias("effect"), F.concat(F.lit(" "), F.col("reason")).alias("reason"))
        own = self.nodes.where(tenth).select("doc_id", F.lit("temporal").alias("expert"), F.col("event_no").alias("ordinal"), F.col("event_id").alias("cause"), F.col("event_id").alias("effect"), F.lit("self").alias("reason"))
        bad = F.array(*[F.struct(F.lit(o).cast("long").alias("ordinal"), F.lit(c).alias("cause"), F.lit(e).alias("effect"), F.lit(r).alias("reason")) for o, c, e, r in ((1, "E1", "E2", "  "), (2, "E2", "E1", "back"), (3, "E1", "X9", "unknown"))])
        odd = self.sized.where(tenth).select("doc_id", F.lit("temporal").alias("expert"), F.inline(bad))
        return clean.unionByName(padded).unionByName(own).unionByName(odd)

    @property
    def answers(self) -> DataFrame:
        """Answers of round 1 for all candidates: `expert_no` 2 and 3."""
        keys = self.near(4).where("(doc_id + 3 * i + j) % 3 = 0 OR (doc_id + i + 2 * j) % 4 = 0").select("doc_id", "i", "j")
        a = "element_at(array('no', 'temporal', ' CAUSAL ', 'casual', 'causal'), cast((doc_id + i + j) % 5 as int) + 1)"
        b = "element_at(array('drop', 'temporal', 'keep', '因果'), cast((doc_id + 2 * i + j) % 4 as int) + 1)"
        rows = keys.select("doc_id", "i", "j", F.inline(F.array(F.struct(F.lit("discourse").alias("expert"), F.lit(2).alias("expert_no"), F.expr(a).alias("label")), F.struct(F.lit("commonsense").alias("expert"), F.lit(3).alias("expert_no"), F.expr(b).alias("label")))))
        return rows.withColumn("ordinal", F.col("i") * 100000 + F.col("j")).withColumn("reason", reason())

    @property
    def verdict_rows(self) -> DataFrame:
        """The judge's rows for the pool."""
        pool = self.near(4).where("((doc_id + 3 * i + j) % 3 = 0 OR (doc_id + i + 2 * j) % 4 = 0) AND ((doc_id + i + j) % 5 >= 2 OR (doc_id + 2 * i + j) % 4 >= 2)")
        label = "element_at(array('no', 'temporal', 'absent', 'causal', 'keep', 'yes'), cast((doc_id + i + 3 * j) % 6 as int) + 1)"
        rows = pool.select("doc_id", "i", "j", F.expr(label).alias("label")).where("label != 'absent'")
        return rows.withColumn("reason", F.when((F.col("doc_id") + F.col("i") + 3 * F.col("j")) % 6 == 3, " ").otherwise(F.concat(F.lit("r"), F.col("i").cast("string")))).withColumn("ordinal", F.col("i") * 100000 + F.col("j"))

    @property
    def vectors(self) -> DataFrame:
        """Each event's vector, one of `embeddings`."""
        e = self.read("embeddings").select("vec_id", "embedding")
        rows = self.nodes.select("doc_id", "event_no").crossJoin(F.broadcast(e.agg(F.count("*").alias("m"))))  # one row
        return rows.withColumn("vec_id", (131 * F.col("doc_id") + F.col("event_no")) % F.col("m")).join(e, "vec_id").select("doc_id", "event_no", "embedding")

    def scores(self, kind: str) -> DataFrame:
        """`doc_id`, `event_no`, `event_id`, `score`: topo, sem, or tie (topo with many ties)."""
        value, gone = {"topo": ("((37 * doc_id + 101 * event_no) % 97) / 97", "(doc_id + event_no) % 10 = 0"), "tie": ("((37 * doc_id + 101 * event_no) % 13) / 13", "(doc_id + event_no) % 10 = 0"), "sem": ("((53 * doc_id + 29 * event_no) % 89) / 89", "(doc_id + 2 * event_no) % 11 = 0")}[kind]
        return self.nodes.select("doc_id", "event_no", "event_id").where(f"NOT ({gone})").withColumn("score", F.expr(value))

    @property
    def graphs(self) -> DataFrame:
        """One row for each document as a graph file has it; some have an event without id, some no list at all of a kind of edge."""
        events = F.array_sort(F.collect_list(F.struct("event_no", "event_id", "text")))
        plain = F.transform(events, lambda e: F.struct(e["event_id"].alias("event_id"), e["text"].alias("text")))
        odd = F.array(F.struct(F.lit("").alias("event_id"), F.lit("no id").alias("text")), F.struct(F.lit(None).cast("string").alias("event_id"), F.lit("null id").alias("text")))
        rows = self.nodes.groupBy("doc_id").agg(plain.alias("events")).withColumn("events", F.when(F.col("doc_id") % 5 == 0, F.concat(odd, "events")).otherwise(F.col("events")))
        name = lambda c: F.concat(F.lit("E"), F.col(c).cast("string"))
        causal = self.causal.groupBy("doc_id").agg(F.collect_list(F.struct(name("i").alias("cause"), name("j").alias("effect"), F.concat(F.lit("c"), F.col("i").cast("string")).alias("reason"))).alias("causal_edges"))
        temporal = self.temporal.groupBy("doc_id").agg(F.collect_list(F.struct(name("i").alias("source"), name("j").alias("target"), F.concat(F.lit("t"), F.col("j").cast("string")).alias("reason"))).alias("temporal_edges"))
        return rows.join(causal, "doc_id", "left").join(temporal, "doc_id", "left")

    @property
    def removal_sets(self) -> DataFrame:
        """Two sets of events for each document by rule, to feed what follows from sets; empty for every seventh document."""
        rows = self.nodes.where("doc_id % 7 != 0").select("doc_id", "event_no", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("set_no"))
        rows = rows.where("(event_no + doc_id) % 4 = 0 OR (event_no + doc_id) % 4 = set_no + 1")
        return rows.groupBy("doc_id", "set_no").agg(F.array_sort(F.collect_list("event_no")).alias("members"))

    @property
    def review_old(self) -> DataFrame:
        temporal = self.temporal.where("NOT ((11 * doc_id + 5 * i + 3 * j) % 7 = 0)")
        rows = self.causal.withColumn("edge_type", F.lit("causal")).unionByName(temporal.withColumn("edge_type", F.lit("temporal")))
        return rows.withColumn("reason", F.concat(F.lit("old "), F.col("i").cast("string")))

    @property
    def added(self) -> DataFrame:
        return self.near(5).where("j = i + 5 AND (doc_id + i) % 8 = 0").select("doc_id", "i", "j", F.lit("causal").alias("edge_type"), F.concat(F.lit("new "), F.col("i").cast("string")).alias("reason"))

    @property
    def review_new(self) -> DataFrame:
        m = (F.col("doc_id") + F.col("i") + F.col("j")) % 9
        rows = self.review_old.where(m != 0)
        flipped = F.when(F.col("edge_type") == "causal", "temporal").otherwise("causal")
        rows = rows.withColumn("edge_type", F.when(m == 1, flipped).otherwise(F.col("edge_type"))).withColumn("reason", F.when(m == 2, F.lit(None)).otherwise(F.col("reason")))
        return rows.unionByName(self.added)

    @property
    def edits(self) -> DataFrame:
        m = (F.col("doc_id") + F.col("i") + F.col("j")) % 9
        flipped = F.when(F.col("edge_type") == "causal", "temporal").otherwise("causal")
        rows = self.review_old.withColumn("action", F.when(m == 0, "delete").when(m == 1, "retype").when(m == 3, "reverse")).where("action IS NOT NULL")
        rows = rows.select("doc_id", "i", "j", "action", F.when(F.col("action") == "retype", flipped).alias("edge_type"), F.when(F.col("action") == "retype", F.concat(F.lit("edit "), F.col("j").cast("string"))).alias("reason"))
        return rows.unionByName(self.added.select("doc_id", "i", "j", F.lit("add").alias("action"), "edge_type", "reason"))


def reason() -> Column:
    return F.concat(F.lit("because "), F.col("i").cast("string"), F.lit("-"), F.col("j").cast("string"))


#: The same tables in SQL, in an order in which later ones use earlier ones.
CTES = {
    "lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents",
    "nodes": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS event_no, 'E' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS event_id, trim(line) AS text FROM lines WHERE trim(line) <> ''",
    "docs": "SELECT doc_id, text, upper(lang) || lpad(doc_id::VARCHAR, 5, '0') || '_' || source || '.txt' AS doc_name FROM documents",
    "sized": "SELECT doc_id, count(*)::BIGINT AS n FROM nodes GROUP BY doc_id",
    "near": "SELECT a.doc_id, a.event_no AS i, b.event_no AS j FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND b.event_no > a.event_no AND b.event_no <= a.event_no + 5",
    "causal": "SELECT doc_id, i, j FROM near WHERE j - i <= 3 AND (11 * doc_id + 5 * i + 3 * j) % 7 = 0",
    "temporal": "SELECT doc_id, i, j FROM near WHERE (j = i + 1 AND (doc_id + i) % 4 <> 0) OR (j = i + 2 AND (doc_id + 2 * i) % 5 = 0)",
    "edges": "SELECT * FROM causal UNION SELECT * FROM temporal",
    "closure": "SELECT doc_id, i, j FROM edges UNION SELECT c.doc_id, c.i, e.j FROM closure c JOIN edges e ON c.doc_id = e.doc_id AND c.j = e.i",
    "degree": "SELECT n.doc_id, n.event_no, (SELECT count(*) FROM edges e WHERE e.doc_id = n.doc_id AND e.j = n.event_no) AS in_degree, (SELECT count(*) FROM edges e WHERE e.doc_id = n.doc_id AND e.i = n.event_no) AS out_degree FROM nodes n",
    "two": "SELECT DISTINCT a.doc_id, a.i, b.j FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.j = b.i WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = a.doc_id AND e.i = a.i AND e.j = b.j)",
    "back2": "SELECT DISTINCT a.doc_id, b.j AS i, a.i AS j FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.j = b.i WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = a.doc_id AND e.i = a.i AND e.j = b.j)",
    "three": "SELECT DISTINCT a.doc_id, a.i, b.j FROM two a JOIN edges b ON a.doc_id = b.doc_id AND a.j = b.i WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = a.doc_id AND e.i = a.i AND e.j = b.j) AND NOT EXISTS (SELECT 1 FROM two e WHERE e.doc_id = a.doc_id AND e.i = a.i AND e.j = b.j)",
    "back3": "SELECT DISTINCT a.doc_id, a.i, b.i AS j FROM back2 a JOIN edges b ON a.doc_id = b.doc_id AND a.j = b.j WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = a.doc_id AND e.j = a.i AND e.i = b.i) AND NOT EXISTS (SELECT 1 FROM back2 e WHERE e.doc_id = a.doc_id AND e.i = a.i AND e.j = b.i)",
    "hops": "SELECT n.doc_id, n.event_no, coalesce(a.c, 0)::BIGINT AS pred_two_hop, coalesce(b.c, 0)::BIGINT AS succ_two_hop, coalesce(c.c, 0)::BIGINT AS pred_three_hop, coalesce(d.c, 0)::BIGINT AS succ_three_hop FROM nodes n LEFT JOIN (SELECT doc_id, i, count(*) c FROM back2 GROUP BY ALL) a ON a.doc_id = n.doc_id AND a.i = n.event_no LEFT JOIN (SELECT doc_id, i, count(*) c FROM two GROUP BY ALL) b ON b.doc_id = n.doc_id AND b.i = n.event_no LEFT JOIN (SELECT doc_id, i, count(*) c FROM back3 GROUP BY ALL) c ON c.doc_id = n.doc_id AND c.i = n.event_no LEFT JOIN (SELECT doc_id, i, count(*) c FROM three GROUP BY ALL) d ON d.doc_id = n.doc_id AND d.i = n.event_no",
    "side_sums": "SELECT n.doc_id, n.event_no, (SELECT count(*) FROM edges e JOIN degree d ON d.doc_id = e.doc_id AND d.event_no = e.j WHERE e.doc_id = n.doc_id AND e.i = n.event_no AND d.in_degree = 1) AS succ_sole_count, (SELECT count(*) FROM edges e JOIN degree d ON d.doc_id = e.doc_id AND d.event_no = e.i WHERE e.doc_id = n.doc_id AND e.j = n.event_no AND d.out_degree = 1) AS pred_sole_count, coalesce((SELECT sum(1.0::DOUBLE / (d.in_degree + d.out_degree)) FROM edges e JOIN degree d ON d.doc_id = e.doc_id AND d.event_no = e.i WHERE e.doc_id = n.doc_id AND e.j = n.event_no), 0) AS pred_inv_degree_sum, coalesce((SELECT sum(1.0::DOUBLE / (d.in_degree + d.out_degree)) FROM edges e JOIN degree d ON d.doc_id = e.doc_id AND d.event_no = e.j WHERE e.doc_id = n.doc_id AND e.i = n.event_no), 0) AS succ_inv_degree_sum FROM nodes n",
    "features": "SELECT doc_id, event_no, in_degree, out_degree, pred_two_hop, succ_two_hop, succ_sole_count, pred_sole_count, pred_three_hop, succ_three_hop, pred_two_hop * succ_two_hop AS reach_local_proxy, pred_inv_degree_sum, succ_inv_degree_sum FROM degree JOIN hops USING (doc_id, event_no) JOIN side_sums USING (doc_id, event_no)",
    "component": "SELECT n.doc_id, n.event_no, least(n.event_no, coalesce(min(l.other), n.event_no)) AS component FROM nodes n LEFT JOIN linked l ON l.doc_id = n.doc_id AND l.event_no = n.event_no GROUP BY n.doc_id, n.event_no",
    "linked": "SELECT doc_id, i AS event_no, j AS other FROM both_ways UNION SELECT l.doc_id, l.event_no, b.j FROM linked l JOIN both_ways b ON b.doc_id = l.doc_id AND b.i = l.other",
    "both_ways": "SELECT doc_id, i, j FROM edges UNION SELECT doc_id, j, i FROM edges",
    "proposals": "SELECT doc_id, 'temporal' AS expert, 0 AS expert_no, i * 100000 + j AS ordinal, i, j FROM near WHERE j - i <= 4 AND (doc_id + 3 * i + j) % 3 = 0 UNION ALL SELECT doc_id, 'precondition', 1, i * 100000 + j, i, j FROM near WHERE j - i <= 4 AND (doc_id + i + 2 * j) % 4 = 0",
    "keys": "SELECT DISTINCT doc_id, i, j FROM proposals",
    "classified": "SELECT doc_id, 'discourse' AS expert, i, j, CASE WHEN (doc_id + i + j) % 5 = 1 THEN 'temporal' ELSE 'causal' END AS kind FROM keys WHERE (doc_id + i + j) % 5 >= 1 UNION ALL SELECT doc_id, 'commonsense', i, j, CASE WHEN (doc_id + 2 * i + j) % 4 = 1 THEN 'temporal' ELSE 'causal' END FROM keys WHERE (doc_id + 2 * i + j) % 4 >= 1",
    "pool": "SELECT doc_id, i, j, string_agg(expert, ',' ORDER BY expert DESC) AS supporters, count(*)::BIGINT AS n_supporters FROM classified WHERE kind = 'causal' GROUP BY doc_id, i, j",
    "verdicts": "SELECT doc_id, i, j, CASE WHEN (doc_id + i + 3 * j) % 6 = 1 THEN 'temporal' WHEN (doc_id + i + 3 * j) % 6 >= 3 THEN 'kept' ELSE 'rejected' END AS verdict, CASE WHEN (doc_id + i + 3 * j) % 6 = 3 THEN 'because ' || i || '-' || j WHEN (doc_id + i + 3 * j) % 6 = 2 THEN 'not kept by the judge' ELSE 'r' || i END AS reason, supporters FROM pool",
    "vectors": "SELECT doc_id, event_no, embedding FROM nodes JOIN embeddings ON vec_id = (131 * doc_id + event_no) % (SELECT count(*) FROM embeddings)",
    "pair_sims": "SELECT a.doc_id, a.event_no AS i, b.event_no AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM vectors a JOIN vectors b ON a.doc_id = b.doc_id AND a.event_no < b.event_no",
    "topo": "SELECT doc_id, event_no, event_id, ((37 * doc_id + 101 * event_no) % 97) / 97.0::DOUBLE AS score FROM nodes WHERE (doc_id + event_no) % 10 <> 0",
    "tie": "SELECT doc_id, event_no, event_id, ((37 * doc_id + 101 * event_no) % 13) / 13.0::DOUBLE AS score FROM nodes WHERE (doc_id + event_no) % 10 <> 0",
    "sem": "SELECT doc_id, event_no, event_id, ((53 * doc_id + 29 * event_no) % 89) / 89.0::DOUBLE AS score FROM nodes WHERE (doc_id + 2 * event_no) % 11 <> 0",
    "topo_ranked": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, event_id)::BIGINT AS rank FROM topo",
    "sem_ranked": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, event_no)::BIGINT AS rank FROM sem",
    "combined": "SELECT coalesce(t.doc_id, s.doc_id) AS doc_id, coalesce(t.event_id, s.event_id) AS event_id, coalesce(t.score, 0) AS topo_score, coalesce(s.score, 0) AS sem_score, coalesce(t.rank, 999) AS topo_rank, coalesce(s.rank, 999) AS sem_rank, 0.5 * coalesce(t.score, 0) + 0.5 * coalesce(s.score, 0) AS combined FROM topo_ranked t FULL JOIN sem_ranked s ON t.doc_id = s.doc_id AND t.event_id = s.event_id",
    "set_members": "SELECT doc_id, event_no, set_no::BIGINT AS set_no FROM nodes, (VALUES (0), (1)) v(set_no) WHERE doc_id % 7 <> 0 AND ((event_no + doc_id) % 4 = 0 OR (event_no + doc_id) % 4 = set_no + 1)",
    "set_counts": "SELECT doc_id, event_no, count(*) AS c FROM set_members GROUP BY doc_id, event_no",
    "c0": "SELECT n.doc_id, n.event_no, coalesce(s.c / (max(s.c) OVER (PARTITION BY n.doc_id))::DOUBLE, 0) AS c0 FROM nodes n LEFT JOIN set_counts s ON s.doc_id = n.doc_id AND s.event_no = n.event_no",
    "s_nd": "SELECT c.doc_id, c.event_no, CASE WHEN c.c0 > 1e-9 THEN 0.0 ELSE coalesce((SELECT sum(m.c0 / greatest(1, d.in_degree + d.out_degree)) FROM both_ways b JOIN c0 m ON m.doc_id = b.doc_id AND m.event_no = b.j JOIN degree d ON d.doc_id = b.doc_id AND d.event_no = b.j WHERE b.doc_id = c.doc_id AND b.i = c.event_no AND m.c0 > 1e-9), 0) END AS s_nd FROM c0 c",
    "split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id)) <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM sized",
    "typed": "SELECT doc_id, i AS src, j AS dst, 0 AS rel FROM temporal UNION ALL SELECT doc_id, j, i, 1 FROM temporal UNION ALL SELECT doc_id, i, j, 2 FROM causal UNION ALL SELECT doc_id, j, i, 3 FROM causal",
    "review_old": "SELECT doc_id, i, j, 'causal' AS edge_type, 'old ' || i AS reason FROM causal UNION ALL SELECT t.doc_id, t.i, t.j, 'temporal', 'old ' || t.i FROM temporal t WHERE NOT (11 * doc_id + 5 * i + 3 * j) % 7 = 0",
    "added": "SELECT doc_id, i, j, 'causal' AS edge_type, 'new ' || i AS reason FROM near WHERE j = i + 5 AND (doc_id + i) % 8 = 0",
    "review_new": "SELECT doc_id, i, j, CASE WHEN (doc_id + i + j) % 9 = 1 THEN CASE WHEN edge_type = 'causal' THEN 'temporal' ELSE 'causal' END ELSE edge_type END AS edge_type, CASE WHEN (doc_id + i + j) % 9 = 2 THEN NULL ELSE reason END AS reason FROM review_old WHERE (doc_id + i + j) % 9 <> 0 UNION ALL SELECT * FROM added",
    "judged": "SELECT 1 AS seed, t.doc_id, t.event_no, t.event_id, t.score, s.score AS label FROM topo t JOIN sem s USING (doc_id, event_no) UNION ALL SELECT 2, t.doc_id, t.event_no, t.event_id, t.score, s.score FROM tie t JOIN sem s USING (doc_id, event_no)",
    "fold_of": "SELECT doc_id, (ntile(2) OVER (ORDER BY md5('42:' || doc_id)) - 1)::BIGINT AS fold FROM sized",
    "fold_counts": "SELECT seed, fold, count(*) FILTER (WHERE score > 0.7 AND label > 0.5) AS tp, count(*) FILTER (WHERE score > 0.7 AND label <= 0.5) AS fp, count(*) FILTER (WHERE score <= 0.7 AND label > 0.5) AS fn, count(*) FILTER (WHERE score <= 0.7 AND label <= 0.5) AS tn FROM judged JOIN fold_of USING (doc_id) GROUP BY seed, fold",
    "fold_loss": "SELECT seed, fold, avg(mse) AS loss FROM (SELECT seed, fold, doc_id, avg((score - label) * (score - label)) AS mse FROM judged JOIN fold_of USING (doc_id) GROUP BY seed, fold, doc_id) x GROUP BY seed, fold",
    "fold_tau": "SELECT d.seed, f.fold, avg(coalesce(p.tau, 0)) AS tau FROM (SELECT DISTINCT seed, doc_id FROM judged) d JOIN fold_of f ON f.doc_id = d.doc_id LEFT JOIN (SELECT a.seed, a.doc_id, avg(sign(a.score - b.score) * sign(a.label - b.label)) AS tau FROM judged a JOIN judged b ON a.seed = b.seed AND a.doc_id = b.doc_id AND a.event_no < b.event_no GROUP BY a.seed, a.doc_id) p ON p.seed = d.seed AND p.doc_id = d.doc_id GROUP BY d.seed, f.fold",
    "judged_ranked": "SELECT *, row_number() OVER (PARTITION BY seed, doc_id ORDER BY score DESC, event_id) AS rank FROM judged",
    "set_sized": "SELECT *, count(*) OVER (PARTITION BY doc_id, set_no) AS size FROM set_members",
    "fold_hits": "SELECT y.seed, f.fold, count(*) FILTER (WHERE y.n > 0) AS hits, count(*) AS docs FROM (SELECT v.seed, m.doc_id, count(*) FILTER (WHERE r.rank <= m.size) AS n FROM set_sized m CROSS JOIN (VALUES (1), (2)) v(seed) LEFT JOIN judged_ranked r ON r.seed = v.seed AND r.doc_id = m.doc_id AND r.event_no = m.event_no GROUP BY v.seed, m.doc_id) y JOIN fold_of f ON f.doc_id = y.doc_id GROUP BY y.seed, f.fold",
    "fold_rows": "SELECT *, CASE WHEN tp > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM fold_counts JOIN fold_loss USING (seed, fold) JOIN fold_tau USING (seed, fold) JOIN fold_hits USING (seed, fold)",
    "event_lists": "SELECT doc_id, '[' || string_agg('{\"event_id\":' || to_json(event_id) || ',\"text\":' || to_json(text) || '}', ',' ORDER BY event_no) || ']' AS events FROM nodes GROUP BY doc_id",
    "pair_texts": "SELECT k.doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.i, k.j) AS edge, '{' || to_json(a.event_id) || ':' || to_json(a.text) || ',' || to_json(b.event_id) || ':' || to_json(b.text) || '}' AS json, to_json([a.event_id, b.event_id]) AS ids FROM keys k JOIN nodes a ON a.doc_id = k.doc_id AND a.event_no = k.i JOIN nodes b ON b.doc_id = k.doc_id AND b.event_no = k.j",
    "candidates": "SELECT doc_id, count(*)::BIGINT AS n, '{' || string_agg('\"edge' || edge || '\":' || json, ',' ORDER BY edge) || '}' AS listed, '{' || string_agg('\"edge' || edge || '\":' || ids, ',' ORDER BY edge) || '}' AS named FROM pair_texts GROUP BY doc_id",
    "first_results": "SELECT doc_id, expert, '{\"expert\":\"' || expert || '\",\"causal_edges\":[' || string_agg('{\"cause\":\"E' || i || '\",\"effect\":\"E' || j || '\",\"reason\":\"because ' || i || '-' || j || '\"}', ',' ORDER BY i, j) || ']}' AS result FROM proposals GROUP BY doc_id, expert",
    "peers": "SELECT doc_id, '{' || string_agg('\"' || expert || '\":' || result, ',' ORDER BY expert) || '}' AS peers FROM first_results GROUP BY doc_id",
    # removal sets of one or two events; every document of sf0.01 in the size band is solved by these
    "whole_pairs": "SELECT s.doc_id, coalesce(c.r, 0) AS r FROM sized s LEFT JOIN (SELECT doc_id, count(*) AS r FROM closure GROUP BY doc_id) c ON c.doc_id = s.doc_id WHERE s.n BETWEEN 3 AND 30",
    "singles": "SELECT n.doc_id, n.event_no AS a, 0 AS b FROM nodes n JOIN whole_pairs p ON p.doc_id = n.doc_id WHERE p.r > 0",
    "walk_one": "SELECT s.doc_id, s.a, s.b, e.i, e.j FROM singles s JOIN edges e ON e.doc_id = s.doc_id AND e.i <> s.a AND e.i <> s.b AND e.j <> s.a AND e.j <> s.b UNION SELECT w.doc_id, w.a, w.b, w.i, e.j FROM walk_one w JOIN edges e ON e.doc_id = w.doc_id AND e.i = w.j AND e.j <> w.a AND e.j <> w.b",
    "solved_one": "SELECT s.doc_id, s.a, s.b, 1 AS k, p.r, coalesce(w.n, 0) AS n_left FROM singles s JOIN whole_pairs p ON p.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, a, b, count(*) AS n FROM walk_one GROUP BY doc_id, a, b) w ON w.doc_id = s.doc_id AND w.a = s.a AND w.b = s.b WHERE coalesce(w.n, 0) <= ceil(0.5 * p.r)",
    "doubles": "SELECT x.doc_id, x.event_no AS a, y.event_no AS b FROM nodes x JOIN whole_pairs p ON p.doc_id = x.doc_id JOIN nodes y ON y.doc_id = x.doc_id AND y.event_no > x.event_no WHERE p.r > 0 AND NOT EXISTS (SELECT 1 FROM solved_one o WHERE o.doc_id = x.doc_id)",
    "walk_two": "SELECT s.doc_id, s.a, s.b, e.i, e.j FROM doubles s JOIN edges e ON e.doc_id = s.doc_id AND e.i <> s.a AND e.i <> s.b AND e.j <> s.a AND e.j <> s.b UNION SELECT w.doc_id, w.a, w.b, w.i, e.j FROM walk_two w JOIN edges e ON e.doc_id = w.doc_id AND e.i = w.j AND e.j <> w.a AND e.j <> w.b",
    "solved_two": "SELECT s.doc_id, s.a, s.b, 2 AS k, p.r, coalesce(w.n, 0) AS n_left FROM doubles s JOIN whole_pairs p ON p.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, a, b, count(*) AS n FROM walk_two GROUP BY doc_id, a, b) w ON w.doc_id = s.doc_id AND w.a = s.a AND w.b = s.b WHERE coalesce(w.n, 0) <= ceil(0.5 * p.r)",
    "least_sets": "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::BIGINT AS set_no, a, b, k::BIGINT AS k, r AS original_pairs, min(n_left) OVER (PARTITION BY doc_id) AS final_pairs FROM (SELECT * FROM solved_one UNION ALL SELECT * FROM solved_two) x UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0 FROM whole_pairs WHERE r = 0",
    "least_counts": "SELECT doc_id, event_no, count(*) AS c FROM (SELECT doc_id, a AS event_no FROM least_sets UNION ALL SELECT doc_id, b FROM least_sets) x WHERE event_no > 0 GROUP BY doc_id, event_no",
    "least_c0": "SELECT n.doc_id, n.event_no, coalesce(s.c / (max(s.c) OVER (PARTITION BY n.doc_id))::DOUBLE, 0) AS c0 FROM nodes n JOIN whole_pairs p ON p.doc_id = n.doc_id LEFT JOIN least_counts s ON s.doc_id = n.doc_id AND s.event_no = n.event_no",
    "least_s_nd": "SELECT c.doc_id, c.event_no, CASE WHEN c.c0 > 1e-9 THEN 0.0 ELSE coalesce((SELECT sum(m.c0 / greatest(1, d.in_degree + d.out_degree)) FROM both_ways b JOIN least_c0 m ON m.doc_id = b.doc_id AND m.event_no = b.j JOIN degree d ON d.doc_id = b.doc_id AND d.event_no = b.j WHERE b.doc_id = c.doc_id AND b.i = c.event_no AND m.c0 > 1e-9), 0) END AS s_nd FROM least_c0 c",
}
#: Tables that a query reads several times.
_READ_OFTEN = ("nodes", "vectors", "pair_sims")
_ORDER = ["lines", "nodes", "docs", "sized", "near", "causal", "temporal", "edges", "both_ways", "linked", "component"]


def sql(select: str) -> str:
    """The query with the tables that it uses, directly or through others."""
    used: set[str] = set()

    def find(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                used.add(name)
                find(CTES[name])

    find(select)
    order = [n for n in _ORDER if n in used] + [n for n in CTES if n in used and n not in _ORDER]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _READ_OFTEN else ''}({CTES[n]})" for n in order) + "\n" + select if used else select
