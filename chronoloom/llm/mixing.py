"""Mixing sources to target weights by capped water-filling.

Sources share the words of all by weight, but none takes more than `epochs` times its own words; what that leaves over is shared
by weight among the others until no source is above its cap. Sorted by cap over weight, the clamped sources are the first
ones, so the level comes from running sums over the sources. A source then takes its documents whole as often as its target
holds them, and once more those first in a seeded order up to the rest.

The seeded order is cut into `CUTS` ranges of its hash. Words by source and range, the only sums over documents, tell for each
source which ranges lie within the rest and in which one range it ends; documents of that range alone are put in order. All other
documents are neither shuffled nor sorted, but meet a row of their source: by a broadcast if there are at most `MOST_SOURCES`, else
by a shuffle in which each source's rows are dealt over `SALTS` tasks.

Defined results: sources go by code point, null last, as one source; a null text has size 0, and what has size 0 is not taken;
a source without words has target 0 and takes nothing; of rows with equal ids the smaller size goes first; repeated rows are documents of their own; an empty table
gives no rows; reruns agree, as the order depends on seed, id and size alone; extra columns are ignored. Running sums over the
sources are in one task, which holds a few numbers for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

EPOCHS = 3
SEED = "mix-1"
#: Ranges of the hash that a source's order is cut into.
CUTS = 4096
#: Sources whose rows of numbers are broadcast at most, about 20 MB; beyond, tasks that each source's rows are dealt over.
MOST_SOURCES, SALTS = 200_000, 64


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: int = 3) -> DataFrame:
    """`source`, `source_size`, `weight`, `target` from rows of `source`, `size`: one row for each source.

    Windows without a partition run over sources here, which a sum with partial aggregation made of the documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    totals = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % weights + 1).cast("long"))
    cap = epochs * F.col("source_size")
    first = Window.orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    rest = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    every = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = left.cast("double") / F.sum("weight").over(rest).cast("double")
    totals = totals.withColumn("level", share).withColumn("clamped", F.col("level") * F.col("weight") >= cap)
    # the level of the first source that isn't clamped, the largest of theirs, holds for all from there on
    level = F.max(F.when(~F.col("clamped"), F.col("level"))).over(every)
    target = F.when(F.col("clamped") | level.isNull(), cap.cast("double")).otherwise(level * F.col("weight"))
    return totals.select("source", "source_size", "weight", target.alias("target"))


def order_hash(seed: str) -> Column:
    """The place of a document in its source's seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def mix(documents: DataFrame, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id`, `size`, `source_size`, `target`, `copies` (times that the mix takes the document) and `taken` of every row;
    with the columns of `keep`."""
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = documents.select("doc_id", "source", words(F.col("text")).alias("size"), order_hash(seed).alias("place"), *kept)
    if not keep:
        rows = tx.stored(rows)  # a few numbers for each document: words are counted once
    rows = rows.withColumn("range", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % CUTS)
    sums = tx.stored(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    shares = targets(sums.select("source", F.col("words").alias("size")), epochs)
    whole = F.floor(F.col("target") / F.col("source_size"))
    shares = shares.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
    shares = shares.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # the range in which the rest ends, with the words before it
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    ends = sums.withColumn("upto", so_far).alias("r").join(shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).where("upto > need")
    ends = ends.groupBy("r.source").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    shares = shares.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    shares = tx.stored(shares.select("s.source", "source_size", "target", "whole", "need", F.coalesce("end.range", F.lit(CUTS)).alias("end"), F.coalesce("end.before", F.lit(0)).alias("before")))
    if shares.count() <= MOST_SOURCES:
        rows = rows.alias("d").join(F.broadcast(shares).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "whole", "need", "end", "before")
    else:
        dealt = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", (F.col("range") % SALTS).cast("int"))
        rows = salted.alias("d").join(dealt.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.salt") == F.col("s.salt"))).select("d.*", "source_size", "target", "whole", "need", "end", "before").drop("salt")
    inside = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # once more if the document's middle lies within the rest
    last = rows.where(F.col("range") == F.col("end")).withColumn("more", 2 * start + F.col("size") <= 2 * F.col("need"))
    out = last.unionByName(rows.where(F.col("range") != F.col("end")).withColumn("more", F.col("range") < F.col("end")))
    more = F.col("more") & (F.col("size") > 0) & (F.col("whole") < epochs)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


#: The same in plain SQL: the level by trying every number of clamped sources, the order over whole sources.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({EPOCHS} * source_size) OVER (
      ORDER BY {EPOCHS} * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY {EPOCHS} * source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
found AS (
  SELECT max(level) AS level FROM levels WHERE level * weight < {EPOCHS} * source_size),
shares AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.level IS NULL OR l.level * l.weight >= {EPOCHS} * l.source_size THEN ({EPOCHS} * l.source_size)::DOUBLE ELSE f.level * l.weight END AS target
  FROM levels l, found f),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM shares),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY conv_range, place, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS place,
          (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT) % {CUTS} AS conv_range FROM sized) s
  JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN 2 * start + size <= 2 * need AND size > 0 AND whole < {EPOCHS} THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
