"""MinHash near-dedup with sequential Bayesian verification.

A text's set is its distinct `WORDS`-word shingles. Equal sets make one class at once. Classes whose signatures agree in one of the
bands are candidates; there are so many bands that a link at the threshold is missed with a probability of at most `MISS`. A
pair of candidates is compared a batch of signature rows at a time: after each batch it is dropped if, by the posterior of its
similarity (uniform prior, so a beta distribution), the chance of reaching the threshold is below `MISS`; what survives all
batches is verified on the full sets.

Each candidate takes as its label the smallest class that it meets in a bucket, and the classes of one label are compared by growing
components: members found linked leave the pool, so a group of near copies costs a few rounds over its members, and what comes out
is a forest of links, not all pairs. A group of more than `BLOCK` members or `BLOCK_SHINGLES` shingles is cut into blocks by a hash,
each a task of its own; then one member of each component is compared with those of the other blocks, again in blocks. So
each class's set is sent once, and nearly all near copies are in one component. What may be missing are links between members of a
bucket that were in different blocks and are still in different components: in such buckets, members outside the largest component
pass by all blocks of their bucket, one after the other, so no task holds more than one block.

Sets are made where texts are read, and signatures and sets of candidates alone are shuffled.

Defined results: texts without words or null have the empty set, link with nothing and are kept; texts of fewer than five words
have their whole sequence as one shingle; rows with equal sets are in one class; the component's id is the smallest id in it,
nulls only if all are null; of rows with equal ids, that with the smallest hash of id and text represents; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

WORDS = 5
#: Probability at which a link is missed by the bands, and by each batch of the verification.
MISS = 1e-6
ROWS = 5
BATCH = 20
#: Members of a bucket, and shingles of theirs, that one task compares with each other.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Bytes of text from which a text's shingles are made piece by piece.
LONG_TEXT = 4 << 20


def bands(threshold: float) -> int:
    """The fewest bands of `ROWS` rows that miss a similarity of `threshold` with a probability of at most `MISS`."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def needed(threshold: float, rows: int) -> np.ndarray:
    """For each number of rows compared, the fewest agreeing ones at which the posterior chance of reaching the threshold is
    still `MISS`: P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = np.zeros(rows + 1, np.int64)
    for n in range(1, rows + 1):
        total, m = 0.0, -1
        while total < MISS and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the bounds of each row's words. A long row is cut at blanks and worked on piece by piece."""
    if len(offsets) == 2 and len(data) > LONG_TEXT:
        blanks = np.flatnonzero(tx.BLANK[data])
        at = np.searchsorted(blanks, np.arange(LONG_TEXT, len(data), LONG_TEXT))
        cuts = np.unique(blanks[at[at < len(blanks)]])
        if len(cuts):
            words = np.concatenate([_plain_hashes(part, np.array([0, len(part)]))[0] for part in np.split(data, cuts)])
            return words, np.array([0, len(words)])
    return _plain_hashes(data, offsets)


def _plain_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tx.lower_ascii(data)
    starts, ends, bounds = tx.word_bounds(low, offsets, ~tx.BLANK)
    return tx.span_hash(tx.prefix_hash(low), starts, ends), bounds


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each row, and their bounds by row."""
    word, bounds = _word_hashes(data, offsets)
    n = len(word)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    shingle = padded[:n].copy()
    for j in range(1, WORDS):
        shingle = shingle * np.uint64(tx.BASE) + padded[j : j + n]
    shingle = tx.mix(shingle)
    count = np.diff(bounds)
    out = []
    for a, k in zip(bounds[:-1].tolist(), count.tolist(), strict=True):
        if k >= WORDS:
            out.append(np.unique(shingle[a : a + k - WORDS + 1]))
        elif k:
            whole = np.full(1, k, np.uint64)
            for i in range(a, a + k):
                whole = tx.mix(whole * np.uint64(tx.OTHER) + word[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _digests(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """128 bits of each row's set."""
    out = np.empty((len(bounds) - 1, 2), np.uint64)
    for i, salt in enumerate((0x51ED270B, 0x2545F491)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(sets ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, i] = total[bounds[1:]] - total[bounds[:-1]]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _signatures(sets: np.ndarray, bounds: np.ndarray, rows: int) -> np.ndarray:
    """The minima of each row's set under each hash function; no set is empty."""
    odd = tx.mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(tx.BASE)) | np.uint64(1)
    out = np.empty((len(bounds) - 1, rows), np.uint32)
    for k in range(rows):
        out[:, k] = np.minimum.reduceat(((sets ^ (odd[k] >> np.uint64(7))) * odd[k]) >> np.uint64(32), bounds[:-1])
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature, with the band's number."""
    n, rows = signatures.shape
    parts = signatures.reshape(n, rows // ROWS, ROWS).astype(np.uint64)
    out = np.tile(np.arange(1, rows // ROWS + 1, dtype=np.uint64), (n, 1))
    for j in range(ROWS):
        out = tx.mix(out * np.uint64(tx.BASE) + parts[:, :, j])
    return out.view(np.int64)


def profiles(documents: DataFrame, rows: int) -> DataFrame:
    """`doc_id`, `row` (128 bits of id and text), `n_shingles`, the set's digest `class`, and `bands` (null for no set)."""

    def work(part: pa.RecordBatch) -> dict[str, object]:
        sets, bounds = _sets(*tx.utf8(part.column(part.schema.get_field_index("text"))))
        size = np.diff(bounds)
        some = np.flatnonzero(size)
        ends = np.zeros(len(size) + 1, np.int32)
        np.cumsum(np.where(size > 0, rows // ROWS, 0), out=ends[1:])
        flat = _bands(_signatures(sets, np.append(bounds[some], len(sets)), rows)).ravel() if len(some) else np.zeros(0, np.int64)
        return {"n_shingles": size, "class": _digests(sets, bounds), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return tx.map_text(keyed(documents), "text", work, fields, ["doc_id", "row"])


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", tx.row_key(F.col("doc_id"), F.col("text")).alias("row"))


def _survivors(one: int, pool: np.ndarray, signatures: np.ndarray, size: np.ndarray, need: np.ndarray, percent: int, own: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Those of the pool whose similarity to one set may reach the threshold: by size, then batch by batch of signature rows."""
    signature, n = own or (signatures[one], size[one])
    small, large = np.minimum(size[pool], n), np.maximum(size[pool], n)
    live = pool[100 * small >= percent * large]
    agree = np.zeros(len(live), np.int64)
    rows = signatures.shape[1]
    for k in range(0, rows, BATCH):
        if not len(live):
            break
        end = min(rows, k + BATCH)
        agree += (signatures[live, k:end] == signature[k:end]).sum(axis=1)
        go = agree >= need[end]
        live, agree = live[go], agree[go]
    return live


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked(signatures: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links among some classes: each is joined to its component by one link that was verified in full."""
    need = needed(percent / 100, signatures.shape[1])
    size = np.array([len(x) for x in sets])
    pool = np.arange(len(sets))
    links = []
    while len(pool):
        todo, pool = [pool[0]], pool[1:]
        while todo and len(pool):
            one = todo.pop()
            found = [x for x in _survivors(one, pool, signatures, size, need, percent).tolist() if _similar(sets[one], sets[x], percent)]
            if found:
                links += [(int(one), x) for x in found]
                todo += found
                pool = pool[~np.isin(pool, found)]
    return links


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The rows of batches with a column `shingles`, made a slice at a time: a batch holds the sets of thousands of texts."""
    for batch in batches:
        for part in tx.slices(batch, "shingles"):
            yield zip(*[c.to_pylist() for c in part.columns], strict=True)


def _in_groups(rows: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Consecutive rows with equal values of the first `keys` columns, as lists of their other values."""
    now, held = None, []
    for part in _parts(rows):
        for row in part:
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


LINKS = "a binary, b binary"


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f(r) for r in rows], pa.binary()) for f in (max, min)], names=["a", "b"])


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked place with the smallest place of its component, from a forest of links."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    for i, j in links:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return [(v, find(v)) for v in root if find(v) != v]


def _links_in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """`a`, `b`: each class that is linked in its block of its label, with the smallest class of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _in_groups(batches, 2):
            group = [r for i, r in enumerate(group) if not i or r[0] != group[i - 1][0]]  # rows with equal id and text
            if len(group) > 1:
                signatures = np.frombuffer(b"".join(r[1] for r in group), np.uint32).reshape(len(group), -1)
                found = linked(signatures, [np.frombuffer(r[2], np.uint64) for r in group], percent)
                yield _pairs([(group[i][0], group[j][0]) for i, j in _stars(found)])  # in the order of their classes

    rows = members.select("label", "block", "class", "signature", "shingles")
    return tx.map_arrow(rows.repartition("label", "block").sortWithinPartitions("label", "block", "class"), run, LINKS)


def _links_across_blocks(members: DataFrame, percent: int) -> DataFrame:
    """`a`, `b`: links between components in the blocks of a bucket.

    `members` has for each block its own members (`place` 0), then members of all blocks that pass by (1). Of each other component
    that a passing one may link to, the first link is kept. Both of a pair that may pass by are compared once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, ready, out = None, [], None, []
        for part in _parts(batches):
            for bucket, block, place, name, root, passes, home, signature, shingles in part:
                if (bucket, block) != now:
                    now, own, ready = (bucket, block), [], None
                if not place:
                    own.append((name, root, passes, signature, shingles))
                    continue
                if not own:
                    continue
                if ready is None:
                    signatures = np.frombuffer(b"".join(x[3] for x in own), np.uint32).reshape(len(own), -1)
                    sets = [np.frombuffer(x[4], np.uint64) for x in own]
                    ready = signatures, sets, np.array([len(x) for x in sets]), needed(percent / 100, signatures.shape[1]), np.array([x[2] for x in own])
                signatures, sets, size, need, moves = ready
                mine = np.frombuffer(shingles, np.uint64)
                pool = np.array([i for i, x in enumerate(own) if x[1] != root and not (moves[i] and (home, name) > (block, x[0]))], np.int64)
                met: set[bytes] = set()
                for i in _survivors(-1, pool, signatures, size, need, percent, (np.frombuffer(signature, np.uint32), len(mine))).tolist():
                    if own[i][1] not in met and _similar(mine, sets[i], percent):
                        met.add(own[i][1])
                        out.append((name, own[i][0]))
            yield _pairs(out)
            out = []

    order = ["bucket", "block", "place"]
    rows = members.select(*order, "class", "root", "passes", "home", "signature", "shingles")
    return tx.map_arrow(rows.repartition("bucket", "block").sortWithinPartitions(*order, "class"), run, LINKS).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` of every node with a link: `root` is the smallest node of its component.

    Large-star and small-star steps in turn: each joins neighbours to the smallest one around, until every node has one edge, to a
    node without one, in a number of rounds that grows with the logarithm of the nodes. Each round is written to the shared
    folder, the one before deleted.
    """
    spark = links.sparkSession
    path = tx.shared_folder(spark)
    edges = tx.stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), path)
    while True:
        several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
        if not several.union(chained).head(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: neighbours above a node go to its smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # a > b
        # small star: neighbours below a node go to the smallest of them
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, path = path, tx.shared_folder(spark)
        edges = tx.stored(small.where("a != b").distinct(), path)
        tx.removed(spark, before)


def _wanted_sets(documents: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """`wanted` (`row` and more) with `signature` and `shingles`, made where texts are read and shuffled once; rows with equal id
    and text come each."""
    texts = tx.sieved(keyed(documents), wanted.select("row"), "row").where("sieved").select("row", "text")

    def work(part: pa.RecordBatch) -> dict[str, object]:
        sets, bounds = _sets(*tx.utf8(part.column(part.schema.get_field_index("text"))))
        signature: list[bytes | None] = [None] * part.num_rows
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            for i, s in zip(some.tolist(), _signatures(sets, np.append(bounds[some], len(sets)), rows), strict=True):
                signature[i] = s.tobytes()
        return {"signature": signature, "shingles": [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}

    made = tx.map_text(texts, "text", work, [T.StructField("signature", T.BinaryType()), T.StructField("shingles", T.BinaryType())], ["row"])
    return made.join(wanted, "row")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """`rows` (`class`, `row`, `n_shingles`, the column `key`) with `blocks` of their key's rows, and their own `block`."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    sizes = sizes.select(key, F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("class", key), F.col("blocks")).cast("int"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` with the `root` of their class, itself if it has no link."""
    return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def _all_links(documents: DataFrame, members: DataFrame, rows: int, percent: int) -> DataFrame:
    """`node`, `root` of all classes with a link, from `members` (`bucket`, `class`, `row`, `n_shingles`) of buckets of two or more."""
    least = members.groupBy("bucket").agg(F.min("class").alias("least"))
    labelled = members.join(least, "bucket").groupBy("class").agg(F.min("least").alias("label"), F.first("row").alias("row"), F.first("n_shingles").alias("n_shingles"))
    placed = tx.stored(_blocks(labelled, "label"))
    roots = components(_links_in_blocks(_wanted_sets(documents, placed.select("row", "class", "label", "block"), rows), percent))

    # groups of several blocks: one member of each component with those of the others, as long as that leaves fewer
    several, n = placed.where("blocks > 1").select("class", "label", "row", "n_shingles"), None
    while several.head(1):
        heads = _rooted(several, roots).groupBy("label", "root").agg(F.min_by(F.struct("class", "row", "n_shingles"), "class").alias("x")).select("label", "x.*")
        heads = tx.stored(_blocks(heads, "label"))
        before, n = n, heads.count()
        if before is not None and 2 * n > before:
            break
        found = tx.stored(_links_in_blocks(_wanted_sets(documents, heads.select("row", "class", "label", "block"), rows), percent))
        if found.head(1):
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
        if not heads.where("blocks > 1").head(1):
            break

    # buckets whose members were not all compared and are still in several components
    named = _rooted(members.join(placed.select("class", "label", "block"), "class"), roots)
    counts = named.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min(F.struct("label", "block")).alias("p0"), F.max(F.struct("label", "block")).alias("p1"))
    open_ = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("n_roots"), F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    open_ = tx.stored(open_.where("n_roots > 1 AND p0 != p1").select("bucket", "largest"))
    if open_.head(1):
        some = named.join(open_, "bucket").select("bucket", "class", "row", "n_shingles", "root", (F.col("root") != F.col("largest")).alias("passes"))
        some = tx.stored(_blocks(some, "bucket"))
        own = F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("place")))
        every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("place")))
        at = F.explode(F.when(F.col("passes"), F.concat(own, every)).otherwise(own)).alias("at")
        dealt = some.select("bucket", "class", "root", "passes", F.col("block").alias("home"), at).select("bucket", "class", "root", "passes", "home", "at.*")
        sets = _wanted_sets(documents, some.select("row", "class").distinct(), rows).dropDuplicates(["class"]).select("class", "signature", "shingles")
        across = tx.stored(_links_across_blocks(dealt.join(sets, "class"), percent))
        if across.head(1):
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across))
    return roots


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """`doc_id`, `row`, `n_shingles`, `component_id` of every row, and `representative`: whether the row stands for its component."""
    n_bands = bands(percent / 100)
    rows = n_bands * ROWS
    found = tx.stored(profiles(documents, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = found.where("n_shingles > 0").groupBy("class").agg(first.alias("first"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_rows"))
    classes = tx.stored(classes)

    banded = classes.select("class", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = banded.join(shared, "bucket").join(classes.select("class", F.col("first.row").alias("row"), "n_shingles"), "class")
    roots = _all_links(documents, tx.stored(members), rows, percent)

    # names of components, and of classes with more than one row; all other rows are alone
    inside = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    several = classes.select("class", "first", "n_rows").join(inside, classes["class"] == inside["node"], "left").where("n_rows > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "class"))
    several = tx.stored(several.select("class", "first", "root"))
    named = several.join(several.groupBy("root").agg(F.min("first").alias("head")), "root").select("class", "head")
    out = found.select("doc_id", "row", "n_shingles", "class").join(named, "class", "left")
    alone = F.col("head").isNull() | (F.col("n_shingles") == 0)
    return out.select(
        "doc_id", "row", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (alone | (F.col("head.row") == F.col("row"))).alias("representative"),
    )


#: What `near_duplicates` returns at 85 percent, in DuckDB's SQL: equal sets once, links by counting shared shingles, components
#: by following links.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), keyed AS (
  SELECT doc_id, s, md5(array_to_string(list_sort(s), chr(10))) AS k FROM sets
), kinds AS (
  SELECT k, min(doc_id) AS least, any_value(s) AS s FROM keyed WHERE len(s) > 0 GROUP BY k
), grams AS (
  SELECT k, len(s) AS n, unnest(s) AS g FROM kinds
), links AS (
  SELECT a.k AS x, b.k AS y FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT k AS x, k AS y FROM kinds UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), components AS (
  SELECT r.x, min(kinds.least) AS c FROM reached r JOIN kinds ON kinds.k = r.y GROUP BY r.x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM keyed LEFT JOIN components ON components.x = keyed.k
"""
