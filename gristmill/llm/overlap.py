"""Pairs of overlapping sets by prefixes, for sets that lie so close together that bands of minima don't tell them apart.

Method. Members are ordered by about how many sets hold them, rarest first, and then by value. Two sets of sizes n and m at
Jaccard similarity t or more have their first common member among the first ``n - ceil(t * n) + 1`` of the one and the
first ``m - ceil(t * m) + 1`` of the other, whatever the order is; so how many sets hold a member needn't be exact, and is
taken from a sketch of fixed size: counts by ``SLOTS`` slots of hashes, which are never too small. What follows the first
common member bounds the overlap, so pairs for which that isn't enough are left out.

A member is frequent if the sketch counts more than ``most`` sets above what a slot holds by chance, so that what is rare stays
so as tables grow. Sets that have no rare member in common can't reach t unless both begin with their frequent ones early
enough: of r and s rare members and f and g frequent ones, ``min(f, g) >= t * (r + s + max(f, g))``.

Pairs within one component are left out, as no link of theirs changes it. So at a frequent member only sets outside its
largest component are joined with others, only with those of a size that can reach t, and members of very many sets are dealt
over several keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .shared import cut, release, written

SLOTS = 1 << 18
#: Sets of one frequent member that meet under one key.
DEALT = 512
#: Slices of the members, and rows that are joined at a time, which are whole slices.
SLICES, AT_ONCE = 32, 2_000_000
_OFTEN = 1 << 62
_U = np.uint64


def _counted(sets: Callable) -> Callable:
    """(slot, held) of a task's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in V.slices(batch.column(2)):
                for s in sets(data, offsets):
                    held += np.bincount((s & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["slot", "held"])

    return run


def _bar(total: int, most: int) -> int:
    """Beyond how many sets of a slot a member is frequent; ``total`` is of all slots."""
    load = total / SLOTS
    return int(most + load + 6 * load**0.5)


def _prefixes(sets: Callable, held: np.ndarray, threshold: int, bar: int) -> Callable:
    """A row for each member of each set's prefix: its key, whose order is that of members, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, component = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(2))
            for lo, _, data, offsets in V.slices(batch.column(2)):
                columns: list[list] = [[] for _ in range(6)]
                for i, s in enumerate(sets(data, offsets)):
                    if not len(s):
                        continue
                    times = held[(s & _U(SLOTS - 1)).astype(np.int64)]
                    # Frequent members after all rare ones, then seven bits of the count's logarithm above the hash.
                    key = ((times > bar).astype(_U) << _U(62)) | (np.minimum(8 * np.log2(times), 127).astype(_U) << _U(55)) | (V.mix(s) >> _U(9))
                    key.sort()
                    n = len(s)
                    first = key[: n - -(-n * threshold // 100) + 1].view(np.int64)
                    for column, value in zip(columns, (ids[lo + i], component[lo + i], n, (key < _U(_OFTEN)).sum())):
                        column.append(np.full(len(first), value, np.int64))
                    columns[4].append(np.arange(len(first), dtype=np.int64))
                    columns[5].append(first)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["node", "component", "n", "rare", "place", "member"])

    return run


def apart(texts: DataFrame, sets: Callable, threshold: int, most: int) -> DataFrame:
    """``(a, b)``, a > b: every two nodes of different components that may have sets at the threshold (percent), and others.

    ``texts(node, component, text)`` has a row or more for each node, and ``sets`` makes a slice of texts (their bytes and
    offsets) into sorted arrays of distinct hashes.
    """
    counts = texts.mapInArrow(_counted(sets), "slot long, held long").groupBy("slot").agg(F.sum("held").alias("held")).collect()  # SLOTS rows at most
    held = np.ones(SLOTS, np.int64)
    for slot, n in counts:
        held[slot] = n
    bar = _bar(sum(n for _, n in counts), most)
    return _met(texts.mapInArrow(_prefixes(sets, held, threshold, bar), "node long, component long, n long, rare long, place long, member long"), threshold)


def apart_native(nodes: DataFrame, members: Column, threshold: int, most: int, keep: ExitStack | None = None) -> DataFrame:
    """As ``apart``, of ``nodes`` with node, component and what ``members``, an array of distinct hashes, is made of, and maps
    of bits (``map_0`` and so on) if there are any. With ``keep`` the pairs are a table of few bytes a pair, until that is closed, and not a checkpoint."""
    slot = lambda x: x.bitwiseAND(F.lit(SLOTS - 1))
    counts = cut(nodes.select(F.explode(members).alias("x")).groupBy(slot(F.col("x")).alias("slot")).agg(F.count("*").alias("held")))
    bar = _bar(counts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0], most)
    dense = nodes.sparkSession.range(SLOTS).withColumnRenamed("id", "slot").join(counts, "slot", "left")
    dense = dense.agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("held", F.lit(1)).alias("held")))).alias("all"))
    dense = cut(dense.select(F.transform("all", lambda x: x["held"]).alias("held")))  # one row of SLOTS numbers

    def key(x: Column) -> Column:
        times = F.get(F.col("held"), slot(x).cast("int"))
        often = F.when(times > bar, F.lit(_OFTEN)).otherwise(F.lit(0).cast("long"))
        return often.bitwiseOR(F.shiftleft(F.least((8 * F.log2(times)).cast("long"), F.lit(127).cast("long")), 55)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x), 9))

    maps = [c for c in nodes.columns if c.startswith("map_")]
    turned = [F.col(c) for c in maps]
    if not maps:
        # 128 bits, each turned over by the members that fall on it: sets that differ in d members differ in d of them at most.
        turned = [F.expr(f"aggregate(set, 0L, (s, x) -> s ^ if(shiftrightunsigned(x, 32) & 1 = {odd}, shiftleft(1L, cast(shiftrightunsigned(x, 33) & 63 as int)), 0L))").alias(f"map_{odd}") for odd in (0, 1)]
        maps = ["map_0", "map_1"]
    rows = nodes.select("node", "component", *[c for c in maps if c in nodes.columns], members.alias("set")).crossJoin(F.broadcast(dense))
    rows = rows.select("node", "component", F.sort_array(F.transform("set", key)).alias("keys"), *turned)
    n = F.size("keys").cast("long")
    rows = rows.select("node", "component", *maps, n.alias("n"), F.size(F.filter("keys", lambda x: x < _OFTEN)).cast("long").alias("rare"), F.expr(f"slice(keys, 1, size(keys) - (size(keys) * {threshold} + 99) div 100 + 1)").alias("first"))
    rows = rows.select("node", "component", *maps, "n", "rare", F.posexplode("first").alias("place", "member"))
    return _met(rows, threshold, keep)


def _met(rows: DataFrame, threshold: int, keep: ExitStack | None = None) -> DataFrame:
    """Pairs of ``rows(node, component, n, rare, place, member)``, and maps of the sets if there are; they are cut. With ``keep``
    members are joined in passes, so that the disk holds one pass's shuffles at a time."""
    if keep is None:
        with written(_between(rows)) as kept:
            release(kept.sparkSession)
            return cut(_joined(kept, threshold))
    found = []
    with written(rows.withColumn("slice", F.pmod(F.xxhash64("member"), F.lit(SLICES)).cast("int")), "slice") as kept:
        release(kept.sparkSession)
        passes = max(1, min(SLICES, -(-kept.count() // AT_ONCE)))
        for n in range(passes):
            some = kept.where(F.pmod(F.col("slice"), F.lit(passes)) == n).drop("slice")
            found.append(keep.enter_context(written(_joined(_between(some), threshold))))
            release(kept.sparkSession)
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return keep.enter_context(written(every.distinct()))


def _between(rows: DataFrame) -> DataFrame:
    """Rows of the members that are in sets of several components."""
    member = Window.partitionBy("member")
    rows = rows.withColumn("lo", F.min("component").over(member)).withColumn("hi", F.max("component").over(member))
    return rows.where("lo <> hi").drop("lo", "hi")


def _joined(rows: DataFrame, threshold: int) -> DataFrame:

    def meets(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        x, y = (side.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in side.columns if c not in on]) for side, s in ((x, "x"), (y, "y")))
        fits = 100 * F.least("n_x", "n_y") >= threshold * F.greatest("n_x", "n_y")
        enough = (100 + threshold) * F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) >= threshold * (F.col("n_x") + F.col("n_y"))
        pairs = x.join(y, on).where((F.col("component_x") != F.col("component_y")) & fits & enough)
        maps = [c for c in rows.columns if c.startswith("map_")]
        if not maps:
            return pairs
        differ = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in maps), F.lit(0))
        return pairs.where(differ * (100 + threshold) <= (100 - threshold) * (F.col("n_x") + F.col("n_y")))

    few, many = rows.where(F.col("member") < _OFTEN), rows.where(F.col("member") >= _OFTEN)
    few = meets(few, few, ["member"]).where("node_x > node_y")
    sizes = many.groupBy("member", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("member").agg(F.ceil(F.sum("size") / DEALT).cast("int").alias("parts"), F.max(F.struct("size", "component"))["component"].alias("main"))
    # Sizes that can reach the threshold are of one class or of two next to each other.
    many = many.join(main, "member").withColumn("class", F.floor(F.log("n") / float(np.log(100.01 / threshold))).cast("int"))
    left = many.where("component <> main").withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    left = left.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")).drop("main", "parts")
    right = many.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("outside", F.col("component") != F.col("main")).drop("main", "parts")
    many = meets(left, right, ["member", "class", "part"]).where("not outside_y or node_x > node_y")
    rest_x, rest_y = (F.col(f"n_{s}") - F.col(f"rare_{s}") for s in "xy")
    many = many.where(100 * F.least(rest_x, rest_y) >= threshold * (F.col("rare_x") + F.col("rare_y") + F.greatest(rest_x, rest_y)))
    return few.select("node_x", "node_y").union(many.select("node_x", "node_y")).select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()
