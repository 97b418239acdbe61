"""Operator 5: near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Method. Texts with the same set of shingles are one class, and its smallest id stands for it. A class has a signature
of ``2 * TREES`` minima. Each tree is one order of that signature (a rotation that begins at the tree's own pair of
minima). In each tree, classes with the same first two minima are a region, and in a region of up to ``REGION`` members
each class meets all others. A larger region is dense: it goes down to prefixes of 4, 8 and 16 minima, where a class meets
only the ``NEAR`` neighbours before it, which are those with the longest common prefix. That finds most links at little
cost, and the members of dense regions that aren't one component by then are settled exactly: all their pairs that
earlier links leave apart come from a prefix-filtered join of their shingles (overlap.apart). So a pair at similarity
0.75 is met unless it shares no region of any size; with 32 trees that has probability (1 - 0.75^2)^32 = 3e-12.

Candidates whose signatures agree too little for the threshold (5 standard deviations) or whose set sizes exclude it
are left out; the others are confirmed on full sets. Confirming goes in rounds: each class's best candidate first, then
every candidate between classes that the first links leave apart, then those of dense regions. So no candidate that could
change a component is dropped. Components come from star contraction (shared.components).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as V
from .overlap import apart
from .shared import components, cut, near, release, table

TREES, REGION, NEAR, DEPTHS = 32, 64, 8, (4, 8, 16)
HASHES = 2 * TREES
_RNG = np.random.default_rng(7)
_XOR, _MUL = (_RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_SKETCH = "doc_id long, n_shingles long, set_hash binary, signature binary, trees array<long>"


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES minima per set; every set must have a member."""
    joined, at = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    return np.stack([np.minimum.reduceat((joined ^ x) * m, at) for x, m in zip(_XOR, _MUL)], axis=1)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in V.slices(batch.column(1)):
                sets = V.shingle_sets(data, offsets, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sign: list = [None] * len(sets)
                trees: list = [None] * len(sets)
                if full:
                    low = V.mix(minima([sets[i] for i in full]))
                    number = np.arange(TREES, dtype=np.uint64)
                    keys = V.mix(low[:, 0::2] * np.uint64(0x9E3779B97F4A7C15) + low[:, 1::2] + number).view(np.int64)
                    labels = (low & np.uint64(255)).astype(np.uint8)
                    for row, i in enumerate(full):
                        sign[i], trees[i] = labels[row].tobytes(), keys[row]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary()), pa.array(trees, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_hash", "signature", "trees"],
                )

    return run


def _least(threshold: int) -> int:
    """In how many places signatures agree at least, at the threshold."""
    rate = threshold / 100
    return int(HASHES * rate - 5.2 * (HASHES * rate * (1 - rate)) ** 0.5)


def _neighbours(threshold: int):
    """Streams rows sorted by (region, order): pairs with the rows before, if signature and sizes allow the threshold.

    In a region that isn't dense these are all rows before, in others the NEAR last ones.
    """
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            region, ids, sizes = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            sign = _rows(batch.column(3))
            wide = batch.column(4).to_numpy(zero_copy_only=False)
            new = len(region)
            if kept:
                region, ids, sizes = (np.concatenate([a, b]) for a, b in zip(kept[:3], (region, ids, sizes)))
                sign, wide = (np.concatenate([a, b]) for a, b in zip(kept[3:], (sign, wide)))
            first = len(region) - new
            out = [(ids[:0], ids[:0], ids[:0])]
            live = np.arange(first, len(region))
            for s in range(1, REGION):
                live = live[live >= s]
                live = live[(region[live] == region[live - s]) & ((s <= NEAR) | ~wide[live])]
                if not len(live):
                    break
                at = live[ids[live] != ids[live - s]]
                small, large = np.minimum(sizes[at], sizes[at - s]), np.maximum(sizes[at], sizes[at - s])
                at = at[small * 100 >= large * threshold]
                agree = (sign[at] == sign[at - s]).sum(axis=1)
                at, agree = at[agree >= least], agree[agree >= least]
                out.append((np.maximum(ids[at], ids[at - s]), np.minimum(ids[at], ids[at - s]), agree.astype(np.int64)))
            a, b, agree = (np.concatenate(x) for x in zip(*out))
            kept = tuple(x[-(REGION - 1) :] for x in (region, ids, sizes, sign, wide))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agree)], ["a", "b", "agree"])

    return run


def _rows(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, HASHES)


def _alike(threshold: int):
    """Pairs whose signatures allow the threshold."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = (_rows(batch.column(2)) == _rows(batch.column(3))).sum(axis=1) >= least
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _confirm(k: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            sets: list = [[], []]
            for side in (0, 1):
                for _, _, data, offsets in V.slices(batch.column(2 + side)):
                    sets[side] += V.shingle_sets(data, offsets, k)
            linked = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(*sets)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = both > 0 and 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])

    return run


def _rotated(tree: Column) -> Column:
    at = 2 * tree
    return F.concat(F.col("signature").substr(at + 1, F.lit(HASHES)), F.col("signature").substr(F.lit(1), at))


def _candidates(classes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, agree) of the classes that meet, and (region, doc_id) of those in dense regions, which don't meet all others."""
    rows = classes.select("doc_id", F.posexplode("trees").alias("tree", "region"))
    shared = rows.groupBy("region").agg(F.count("*").alias("members")).where("members > 1")
    rows = rows.join(shared, "region").join(classes.select("doc_id", "n_shingles", "signature"), "doc_id")
    rows = cut(rows.select("region", "doc_id", "n_shingles", _rotated(F.col("tree")).alias("sign"), "members"))
    done = rows.where(F.col("members") <= REGION).drop("members").withColumn("wide", F.lit(False))
    deep = rows.where(F.col("members") > REGION).drop("members").withColumn("wide", F.lit(True))
    dense = deep.select("region", "doc_id")
    for depth in DEPTHS:
        deep = deep.withColumn("region", F.xxhash64("region", F.col("sign").substr(1, depth)))
        count = deep.groupBy("region").agg(F.count("*").alias("members"))
        if depth == DEPTHS[-1]:
            deep = deep.join(count.where("members > 1"), "region").drop("members")
            break
        deep = deep.join(count.where("members > 1"), "region")
        done = done.union(deep.where(F.col("members") <= REGION).drop("members"))
        deep = deep.where(F.col("members") > REGION).drop("members")
    rows = done.union(deep).repartition("region").sortWithinPartitions("region", "sign", "doc_id")
    pairs = rows.select("region", "doc_id", "n_shingles", "sign", "wide").mapInArrow(_neighbours(threshold), "a long, b long, agree long")
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), dense


def _unsettled(dense: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, component) of the classes in dense regions that aren't one component."""
    rows = dense.join(near(parts.select(F.col("node").alias("doc_id"), "component")), "doc_id", "left")
    rows = cut(rows.withColumn("component", F.coalesce("component", "doc_id")))
    several = rows.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("region")
    return cut(rows.join(near(several), "region", "left_semi").select("doc_id", "component").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    Linked are texts with ``100 * |intersection| >= threshold * |union|`` of their k-word shingle sets (A-Z lower-cased,
    words ended by ASCII white space). ``component_id`` is the smallest id that links reach.

    Null, empty and blank texts have no shingles and are linked with nothing. A row with a null id is linked with
    nothing, has a null component and is kept. Rows that share an id are one node, and each of them has its row. An
    empty table gives no rows. Columns other than the two named are not read. Texts of any length are taken whole.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = cut(docs.mapInArrow(_sketches(k), _SKETCH))
    linked = sketches.where("set_hash is not null and doc_id is not null")
    groups = linked.groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    chosen = groups.select(F.col("rep").alias("doc_id"), "set_hash")
    classes = linked.select("doc_id", "n_shingles", "signature", "trees", "set_hash").join(chosen, ["doc_id", "set_hash"]).dropDuplicates(["doc_id", "set_hash"])
    pairs, dense = _candidates(classes.select("doc_id", "n_shingles", "signature", "trees"), threshold)
    pairs = cut(pairs)
    release(docs.sparkSession)
    wanted = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    within = lambda ids: docs.where("doc_id is not null").join(near(ids), "doc_id", "left_semi")
    texts = cut(within(wanted))

    def confirmed(some: DataFrame, texts: DataFrame = texts) -> DataFrame:
        left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        both = some.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_confirm(k, threshold), "a long, b long")

    best = Window.partitionBy("a").orderBy(F.desc("agree"), "b")
    first = cut(confirmed(pairs.withColumn("place", F.row_number().over(best)).where("place = 1")))
    parts = components(first)
    ends = pairs
    for x in "ab":
        of = parts.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        ends = ends.join(of, x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    links = cut(first.union(confirmed(ends.where("of_a <> of_b"))))
    parts = components(links)
    release(docs.sparkSession)
    dense = _unsettled(dense, parts)
    if not dense.isEmpty():
        whole = within(dense.select("doc_id")).join(dense, "doc_id").select("doc_id", "component", "text")
        some = apart(whole, lambda data, offsets: V.shingle_sets(data, offsets, k), threshold, REGION)
        for x in "ab":
            some = some.join(classes.select(F.col("doc_id").alias(x), F.col("signature").alias(f"signature_{x}")), x)
        some = cut(some.select("a", "b", "signature_a", "signature_b").mapInArrow(_alike(threshold), "a long, b long").distinct())
        if not some.isEmpty():
            ids = cut(some.select(F.col("a").alias("doc_id")).union(some.select("b")).distinct())
            parts = components(links.union(confirmed(some, within(ids))))

    reps = groups.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reps = reps.select("set_hash", F.coalesce("component", "rep").alias("component"))
    rows = sketches.select("doc_id", "n_shingles", "set_hash").join(reps, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, less those that aren't kept. Rows with a null id stay."""
    out = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(out, F.col(id_col).cast("long") == F.col("__dropped"), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op5_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents
), s as (
  select distinct doc_id, array_to_string(l[i:i+4], ' ') as g from (select doc_id, l, unnest(range(1, greatest(len(l) - 3, 2))) as i from w where len(l) > 0)
), n as (select doc_id, count(*) as n from s group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as hits from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * hits >= 75 * (x.n + y.n - hits)
), l as (select a, b from e union all select b, a from e
), r(doc_id, c) as (
  select doc_id, doc_id from documents union select l.b, r.c from r join l on l.a = r.doc_id where r.c < l.b
), m as (select doc_id, min(c) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d join m on m.doc_id = d.doc_id left join n on n.doc_id = d.doc_id""",
}
