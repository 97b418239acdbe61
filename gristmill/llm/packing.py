"""Operator 1: best-fit packing with bins of several sizes.

Method. Pieces are taken from long to short. A piece goes to the open bin that it fills best; if none has room, a bin of
the least cost per place that holds it is opened. At the end each bin is downsized to the cheapest size that holds its
contents. The sizes are optimised jointly: this is done once for each size as the least to open, and the cheapest result
is taken. A size's cost is ``size + OVERHEAD + size^2 / QUADRATIC``, for the places themselves, what any sequence costs,
and attention.

Pieces are dealt by hash into shards of about ``SHARD`` pieces, which are packed each on its own: the number of shards
follows the input, and each shard loses a few part-filled bins at most, which downsizing makes cheap.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table

SIZES, SHARD, OVERHEAD, QUADRATIC = (512, 1024, 2048, 4096, 8192), 8192, 64, 16384
_BINS = "bin_id long, capacity int, used int, doc_ids array<long>, starts array<long>, lengths array<int>"
_WORD = r"[^\x20\x09-\x0D]+"


def cost(size: int) -> float:
    return size + OVERHEAD + size * size / QUADRATIC


def _fill(lengths: Sequence[int], sizes: Sequence[int]) -> list[tuple[int, list[int]]]:
    """Bins as (room used, indices of pieces), for lengths in descending order; sizes are those that may be opened."""
    ranked = sorted(sizes, key=lambda s: (cost(s) / s, s))
    rooms: dict[int, list[int]] = {}
    order: list[int] = []
    bins: list[tuple[int, list[int]]] = []
    for i, length in enumerate(lengths):
        at = bisect_left(order, length)
        if at < len(order):
            room = order[at]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
        else:
            b, room = len(bins), next(s for s in ranked if s >= length)
            bins.append((0, []))
        bins[b] = (bins[b][0] + length, bins[b][1])
        bins[b][1].append(i)
        room -= length
        if room:
            if room not in rooms:
                rooms[room] = []
                order.insert(bisect_left(order, room), room)
            rooms[room].append(b)
    return bins


def pack_shard(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> list[tuple[int, int, list[int]]]:
    """(capacity, used, indices) of each bin, for lengths in descending order, none above the largest size."""
    best, least = [], float("inf")
    for i in range(len(sizes)):
        bins = [(min((s for s in sizes if s >= used), key=cost), used, pieces) for used, pieces in _fill(lengths, sizes[i:])]
        total = sum(cost(capacity) for capacity, _, _ in bins)
        if total < least:
            best, least = bins, total
    return best


def _pack(sizes: Sequence[int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row", "start"], ascending=[False, True, True])
        ids, starts, lengths = ([None if pd.isna(x) else int(x) for x in rows[c].astype(object)] for c in ("doc_id", "start", "length"))
        first = int(rows["shard"].iloc[0]) << 24
        bins = pack_shard(lengths, sizes)
        pick = lambda of: [[of[i] for i in pieces] for _, _, pieces in bins]
        return pd.DataFrame({"bin_id": np.arange(len(bins), dtype=np.int64) + first, "capacity": [b[0] for b in bins], "used": [b[1] for b in bins], "doc_ids": pick(ids), "starts": pick(starts), "lengths": pick(lengths)})

    return run


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "length", sizes: Sequence[int] = SIZES, shard: int = SHARD) -> DataFrame:
    """``(bin_id, capacity, used, doc_ids, starts, lengths)``, a row for each bin. Entry j of the three lists is a piece:
    its text's id, the place in the text where it begins, and its length.

    A text longer than the largest size is cut into pieces of that size and a rest; nothing is left out. A null or zero
    length has no piece. Rows with null or repeated ids are texts of their own. An empty table gives no bins. Columns
    other than the two named are not read.
    """
    sizes = sorted(sizes)
    most = sizes[-1]
    rows = lengths.select(F.col(id_col).cast("long").alias("doc_id"), F.col(length_col).cast("long").alias("whole")).where("whole > 0")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    pieces = rows.select("doc_id", "row", "whole", F.explode(F.expr(f"sequence(0L, (whole - 1) div {most})")).alias("n"))
    pieces = pieces.select("doc_id", "row", (F.col("n") * most).alias("start"), F.least(F.col("whole") - F.col("n") * most, F.lit(most)).cast("int").alias("length"))
    count = rows.agg(F.sum(F.expr(f"(whole + {most - 1}) div {most}"))).first()[0] or 0
    shards = max(1, -(-count // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack(sizes), _BINS)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``pack`` for texts, whose lengths are their words (ended by ASCII white space); a null text has none."""
    words = F.regexp_count(F.col(text_col).cast("string"), F.lit(_WORD))
    return pack(docs.select(F.col(id_col).alias("doc_id"), words.alias("length")), **options)


def packed_texts(docs: DataFrame, bins: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(bin_id, capacity, texts)``: the pieces' words, joined by blanks, in the bin's order. Ids must be distinct."""
    pieces = bins.select("bin_id", "capacity", F.posexplode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("place", "p"))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = pieces.join(texts, F.col("p.doc_ids") == F.col("__id"))
    part = F.array_join(F.slice(F.regexp_extract_all("__text", F.lit(_WORD), F.lit(0)), F.col("p.starts").cast("int") + 1, F.col("p.lengths")), " ")
    return rows.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("text")))).alias("t")).select("bin_id", "capacity", F.col("t.text").alias("texts"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
