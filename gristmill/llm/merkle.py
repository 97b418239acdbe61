"""Operator 13: a Merkle manifest of a table, with a proof for each row.

Method. A row's digest is its leaf; the leaves of one tree (a language) ascend by id and stand at places 0, 1, 2, ... Places
come from a range partitioning and the counts of its parts, so no tree is sorted in one task. From there all is index
arithmetic: a block of ``fanout ** HEIGHT`` consecutive leaves is aligned, so it is a subtree whatever the tree's size. Each
block is one contiguous matrix of 64-byte hex digests; a level is the matrix reshaped by the fanout and hashed row by row,
and the siblings of the node at place i are the rest of the row i // fanout. A block gives its root, which stands at the
block's number among the leaves of the next tier, and the siblings of each of its leaves. Tiers go on until every tree is
one node; then the trees' roots, by language, are the leaves of one more tree.

A row's siblings in later tiers come by its block's number, so that join's keys have at most a block's rows. Each row is
then folded up to the root by itself, from its place, its tree's size and its siblings alone, as a verifier would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import crc32_sql, cut, near, table

FANOUT = 2
#: Levels of a block: 1,024 leaves at a fanout of two.
HEIGHT = 10
_NODES = "tree string, known boolean, at long, total long, digest string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _hashed(matrix: np.ndarray) -> np.ndarray:
    """The hex digest of each row of a matrix of bytes."""
    data, width = matrix.tobytes(), matrix.shape[1]
    joined = b"".join(hashlib.sha256(data[a : a + width]).hexdigest().encode() for a in range(0, len(data), width))
    return np.frombuffer(joined, np.uint8).reshape(-1, 64)


def block_levels(leaves: np.ndarray, fanout: int, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The root of a block after ``levels`` levels, as a matrix of one row, and each level's matrix of digests below it."""
    seen, now = [], leaves
    for _ in range(levels):
        seen.append(now)
        whole = len(now) // fanout * fanout
        above = [_hashed(now[:whole].reshape(-1, 64 * fanout))] if whole else []
        if whole < len(now):
            above.append(_hashed(now[whole:].reshape(1, -1)))
        now = np.concatenate(above)
    return now, seen


def height(total: int, fanout: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while total > 1:
        total, levels = -(-total // fanout), levels + 1
    return levels


def siblings(seen: list[np.ndarray], fanout: int) -> list[bytes]:
    """For each leaf of a block the siblings' digests, level by level and from left to right."""
    places = np.arange(len(seen[0]))
    parts = []
    for level in seen:
        first = places // fanout * fanout
        columns = [(np.minimum(first + k, len(level) - 1), (first + k != places) & (first + k < len(level))) for k in range(fanout)]
        parts.append([b"".join(level[at[i]].tobytes() for at, real in columns if real[i]) for i in range(len(places))])
        places = places // fanout
    return [b"".join(x) for x in zip(*parts)]


def fold(digest: bytes, at: int, total: int, proof: bytes, fanout: int, begin: int = 0) -> tuple[bytes, int]:
    """The tree's root by a leaf's digest, its place, the tree's size and the siblings from ``begin`` on; where they end."""
    while total > 1:
        place = at % fanout
        others = min(fanout, total - (at - place)) - 1
        left, end = begin + 64 * place, begin + 64 * others
        digest = hashlib.sha256(proof[begin:left] + digest + proof[left:end]).hexdigest().encode()
        begin, at, total = end, at // fanout, -(-total // fanout)
    return digest, begin


def numbered(rows: DataFrame, tree: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, the place from 0 up within its tree, and ``total``, the tree's size. The columns of ``tree`` and
    ``order`` decide all places but those of equal rows. What is sorted is dealt out by ranges of all of them, so a tree
    spreads over many parts; what is kept of a part are its counts, a row for each tree in it."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = cut(rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *tree, *order, "nth").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", *tree).agg(F.count("*").alias("here"))
    by_tree = Window.partitionBy(*tree)
    counts = cut(counts.select("part", *tree, F.sum("here").over(by_tree).alias("total"), (F.sum("here").over(by_tree.orderBy("part")) - F.col("here")).alias("before")))
    within = F.row_number().over(Window.partitionBy("part", *tree).orderBy(*order, "nth"))
    same = F.lit(True)
    for c in ("part", *tree):
        same = same & dealt[c].eqNullSafe(F.col(f"c.{c}"))
    dealt = dealt.withColumn("within", within).alias("d").join(near(counts).alias("c"), same)
    return dealt.select(*[F.col(f"d.{c}") for c in rows.columns], (F.col("c.before") + F.col("d.within") - 1).alias("at"), F.col("c.total").alias("total"))


def _tier(fanout: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    """A block's rows to its root's row and a row of siblings for each of its nodes."""
    size = fanout**levels

    def run(rows: pa.Table) -> pa.Table:
        at = np.asarray(rows["at"])
        order = np.argsort(at)
        at, total = at[order], rows["total"][0].as_py()
        digests = rows["digest"].combine_chunks().take(pa.array(order))
        matrix = np.frombuffer(b"".join(digests.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, 64)
        root, seen = block_levels(matrix, fanout, min(levels, height(total, fanout)))
        found = siblings(seen, fanout) if seen else [b""] * len(at)
        tree, known = rows["tree"][0], rows["known"][0]
        n = len(at)
        return pa.table({
            "tree": pa.array([tree.as_py()] * (n + 1), pa.string()), "known": pa.array([known.as_py()] * (n + 1), pa.bool_()),
            "at": pa.array([*at.tolist(), int(at[0]) // size], pa.int64()), "total": pa.array([total] * n + [-(-total // size)], pa.int64()),
            "digest": pa.array([*digests.to_pylist(), root.tobytes().decode()], pa.string()),
            "siblings": pa.array([*(x.decode() for x in found), None], pa.string()), "is_root": pa.array([False] * n + [True], pa.bool_()),
        })

    return run


def _climb(nodes: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes ``(tree, known, at, total, digest)`` the nodes with their ``siblings`` up to the tree's root, and the trees'
    roots ``(tree, known, digest)``. Each tier is cut, as its rows go both ways; a later one has a block's share of rows."""
    size = fanout**levels
    block = F.expr(f"at div {size}")
    done = cut(nodes.groupBy("tree", "known", block.alias("block")).applyInArrow(_tier(fanout, levels), f"{_NODES}, siblings string, is_root boolean"))
    here, roots = done.where("not is_root").drop("is_root"), done.where("is_root").select("tree", "known", "at", "total", "digest")
    if roots.where("total > 1").isEmpty():
        return here, roots.select("tree", "known", "digest")
    above, tops = _climb(roots, fanout, levels)
    above = above.select("tree", "known", F.col("at").alias("block"), F.col("siblings").alias("upper"))
    own = here.withColumn("block", block)
    same = own.tree.eqNullSafe(above.tree) & (own.known == above.known) & (own.block == above.block)
    return own.join(above, same).select(own.tree, own.known, own.at, own.total, own.digest, F.concat(own.siblings, above.upper).alias("siblings")), tops


def _proved(fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            proofs, folded = [], []
            for digest, at, total, own, tree_at, trees, upper in zip(*(rows[c] for c in ("given", "at", "total", "siblings", "tree_at", "trees", "upper"))):
                proof = (own + upper).encode()
                proofs.append(hashlib.sha256(proof).hexdigest())
                now, end = fold(digest.encode(), at, total, proof, fanout)
                folded.append(fold(now, tree_at, trees, proof, fanout, end)[0].decode())
            keep = [batch.column(c) for c in ("doc_id", "leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", id_col: str = "doc_id", given: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = HEIGHT) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row for each row of ``docs``.

    A leaf is the digest of the columns in order. ``given`` are the values that a verifier has of some columns, where they
    may differ from the table's: ``folded_root`` is what they lead to along the original siblings, and ``verified`` whether
    that is the root. A null value is told apart from an empty one; a null in ``tree_col`` is a tree of its own, the first;
    trees are in the order of UTF-8 bytes. Ids ascend, a null id first; rows of one id are in the order of their leaves, and
    equal rows are each a leaf of their own. An empty table gives no rows. Columns other than those named are not read.
    Texts are hashed whole, once for the leaf, and once more where a given value differs.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("a tree needs a fanout of two and a level at least")
    own = leaf([F.col(c) for c in columns])
    differs = F.lit(False)
    for c, value in (given or {}).items():
        differs = differs | ~F.col(c).eqNullSafe(value)
    other = F.when(differs, leaf([(given or {}).get(c, F.col(c)) for c in columns]))
    # The texts end here: what is dealt out has two digests at most.
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(tree_col).cast("string"), F.lit("")).alias("tree"), F.col(tree_col).isNotNull().alias("known"), own.alias("leaf"), other.alias("other")))
    rows = cut(numbered(rows, ["known", "tree"], ["doc_id", "leaf"]))
    paths, tops = _climb(rows.select("tree", "known", "at", "total", F.col("leaf").alias("digest")), fanout, levels)
    trees = numbered(tops.withColumn("one", F.lit("")), ["one"], ["known", "tree"])
    upper, top = _climb(trees.select(F.col("one").alias("tree"), F.lit(True).alias("known"), "at", "total", "digest"), fanout, levels)
    trees = trees.join(upper.select("at", F.col("siblings").alias("upper")), "at").crossJoin(F.broadcast(top.select(F.col("digest").alias("root"))))  # the root is one row
    trees = trees.select("tree", "known", F.col("digest").alias("subroot"), F.col("at").alias("tree_at"), F.col("total").alias("trees"), "upper", "root")
    rows = rows.join(paths.select("tree", "known", "at", "siblings"), ["tree", "known", "at"])
    rows = rows.join(near(cut(trees)), ["tree", "known"]).withColumn("given", F.coalesce("other", "leaf"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", "given", "at", "total", "siblings", "tree_at", "trees", "upper")
    rows = rows.mapInArrow(_proved(fanout), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), given={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def _oracle() -> str:
    of = lambda v: f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')"
    leaf_of = lambda n: "sha256(" + " || ".join(of(v) for v in ("doc_id", "source", "lang", n, "text")) + ")"
    levels = lambda name, start: f"""{name}(tree, k, i, n, d) as (
  {start} union all select tree, k + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' order by i)) from {name} where n > 1 group by tree, k, i // {FANOUT}, n)"""  # noqa: E731
    return f"""
with recursive leaves as (
  select doc_id, coalesce('=' || lang, '') as tree, {leaf_of('n_chars')} as leaf, {leaf_of(f"n_chars + case when {crc32_sql('doc_id::varchar')} % 7 = 0 then 1 else 0 end")} as given from documents
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as total from leaves
), {levels('low', 'select tree, 0, pos, total, leaf from placed')}
, roots as (select tree, d as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as total from low where n = 1
), {levels('high', "select '', 0, pos, total, subroot from roots")}
, path as (
  select p.tree, p.pos, 0 as part, s.k, s.i, s.d, s.i % {FANOUT} as side from placed p join low s on s.tree = p.tree and s.i // {FANOUT} = (p.pos >> s.k) // {FANOUT} and s.i <> p.pos >> s.k and s.n > 1
  union all select r.tree, p.pos, 1, s.k, s.i, s.d, s.i % {FANOUT} from placed p join roots r on r.tree = p.tree join high s on s.i // {FANOUT} = (r.pos >> s.k) // {FANOUT} and s.i <> r.pos >> s.k and s.n > 1
), proofs as (select tree, pos, sha256(string_agg(d, '' order by part, k, i)) as proof_sha256 from path group by 1, 2
), heights as (select tree, max(k) as tall from low group by 1
), steps as (
  select p.tree, p.pos, h.part, h.k, row_number() over (partition by p.tree, p.pos order by h.part, h.k) as step, x.d, x.side
  from placed p join (select tree, 0 as part, unnest(range(0, tall)) as k from heights union all select t.tree, 1, unnest(range(0, (select max(k) from high))) from heights t) h on h.tree = p.tree
  left join path x on x.tree = p.tree and x.pos = p.pos and x.part = h.part and x.k = h.k
), folds(tree, pos, step, d) as (
  select tree, pos, 0::bigint, given from placed
  union all select f.tree, f.pos, s.step, sha256(case when s.d is null then f.d when s.side = 0 then s.d || f.d else f.d || s.d end) from folds f join steps s on s.tree = f.tree and s.pos = f.pos and s.step = f.step + 1
), folded as (select tree, pos, d as folded_root from folds qualify row_number() over (partition by tree, pos order by step desc) = 1)
select p.doc_id, p.leaf, r.subroot, t.root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, f.folded_root, f.folded_root = t.root as verified
from placed p join roots r on r.tree = p.tree cross join (select d as root from high where n = 1) t left join proofs q on q.tree = p.tree and q.pos = p.pos join folded f on f.tree = p.tree and f.pos = p.pos"""


ORACLE = {"op13_merkle_manifest": _oracle()}
