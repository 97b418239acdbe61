"""Operator 8: benchmark decontamination by winnowing.

Method. Of each k words in a row a hash is taken, and of each w such hashes in a row the smallest (the rightmost of
equals) is kept as a fingerprint. Two texts that share a span of ``w + k - 1`` words keep a common fingerprint of it.
With k = 5 and w = 6, no shared window of 10 words is missed; items of fewer words have parameters of their own that
guarantee their whole length. Fingerprints of training and test texts are joined, and each hit is extended: the windows
that hold the fingerprint are compared in full.

The test side is broadcast only while its fingerprints and windows are at most ``BROADCAST_ROWS``, which is checked by
a count; texts then stay where they are read. Beyond that, both joins are shuffled (``_by_shuffle``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .shared import cut, table

WINDOW = 10
#: 8 bytes each, so that what is broadcast is 16 MB at most.
BROADCAST_ROWS = 2_000_000


def parameters(length: int) -> tuple[int, int]:
    """k and w that guarantee spans of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


def _text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = V.LOWER[data]
    starts, ends, bounds = V.words(data, offsets, V.ALNUM)
    return V.word_hashes(data, starts, ends), bounds


def _inside(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the first n places begin a run of ``size`` words within one text."""
    end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + size <= end


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that winnowing keeps, for spans of ``length`` words."""
    k, w = parameters(length)
    grams = V.window_hashes(hashes, k)
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams[:0]
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        nearer = grams[j : j + n] <= best
        best[nearer] = grams[j : j + n][nearer]
        at[nearer] = np.flatnonzero(nearer) + j
    at = np.unique(at[_inside(bounds, length, n)])
    return at, grams[at]


def _seeded(hashes: np.ndarray, length: int) -> np.ndarray:
    return V.mix(hashes + np.uint64(length)).view(np.int64)


def _windows_at(hashes: np.ndarray, bounds: np.ndarray, length: int, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``length`` words that hold a k-gram beginning at one of ``hits``."""
    _, w = parameters(length)
    full = V.window_hashes(hashes, length)
    starts = np.unique((hits[:, None] - np.arange(w)).ravel())
    starts = starts[(starts >= 0) & (starts < len(full))]
    starts = starts[_inside(bounds, length, len(full))[starts]]
    return starts, _seeded(full[starts], length)


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _item_rows(kind: str):
    """For each item its windows, or the fingerprints of them, with the length of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in V.slices(batch.column(1)):
                hashes, bounds = _text_words(data, offsets)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if a == b:
                        continue
                    own, length = hashes[a:b], min(WINDOW, b - a)
                    if kind == "windows":
                        values = V.window_hashes(own, length)
                    else:
                        values = fingerprints(own, np.array([0, b - a]), length)[1]
                    values = np.unique(_seeded(values, length))
                    item = batch.column(0).slice(lo + i, 1)[0].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(values), pa.string()), pa.array([length] * len(values), pa.int32()), pa.array(values)], ["item", "length", "hash"])

    return run


def _spread(hits: np.ndarray, starts: np.ndarray, length: int) -> None:
    for j in range(length):
        hits[starts + j] = True


def _document_rows(prints: dict[int, np.ndarray], windows: dict[int, np.ndarray]):
    """With the test side at hand: words, hit words and the hashes of the windows that occur, for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in V.slices(batch.column(1)):
                hashes, bounds = _text_words(data, offsets)
                hit = np.zeros(len(hashes), bool)
                place, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for length, known in prints.items():
                    at, values = fingerprints(hashes, bounds, length)
                    at = at[_among(_seeded(values, length), known)]
                    if len(at):
                        starts, values = _windows_at(hashes, bounds, length, at)
                        same = _among(values, windows[length])
                        place.append(starts[same])
                        found.append(values[same])
                        _spread(hit, starts[same], length)
                sums = np.r_[0, np.cumsum(hit)]
                place, found = np.concatenate(place), np.concatenate(found)
                order = np.argsort(place, kind="stable")
                place, found = place[order], found[order]
                edges = np.searchsorted(place, bounds)
                lists = [np.unique(found[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc_id", "n_words", "n_hit", "windows"],
                )

    return run


def _print_rows(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in V.slices(batch.column(1)):
                hashes, bounds = _text_words(data, offsets)
                for length in lengths:
                    at, values = fingerprints(hashes, bounds, length)
                    row = np.searchsorted(bounds, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(np.full(len(at), length, np.int32)), pa.array(at - bounds[row]), pa.array(_seeded(values, length))],
                        ["row", "length", "at", "hash"],
                    )

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, hits as array of (length, at)): the windows around these hits."""
    for batch in batches:
        hits = batch.column(2).to_pylist()
        for lo, hi, data, offsets in V.slices(batch.column(1)):
            hashes, bounds = _text_words(data, offsets)
            for i in range(lo, hi):
                a, b = bounds[i - lo : i - lo + 2].tolist()
                own = np.array([0, b - a])
                for length in sorted({h["length"] for h in hits[i]}):
                    at = np.array([h["at"] for h in hits[i] if h["length"] == length])
                    starts, values = _windows_at(hashes[a:b], own, length, at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(starts), pa.int64()), pa.array([length] * len(starts), pa.int32()), pa.array(starts), pa.array(values)],
                        ["row", "length", "at", "hash"],
                    )


def _by_shuffle(docs: DataFrame, prints: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of _document_rows where the test side is too large to broadcast. Texts are moved for hit rows only."""
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    lengths = [r[0] for r in prints.select("length").distinct().collect()]
    own = docs.select("row", "text").mapInArrow(_print_rows(lengths), "row long, length int, at long, hash long")
    hits = own.join(prints.select("length", "hash").distinct(), ["length", "hash"], "left_semi")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("length", "at")).alias("hits"))
    around = docs.join(hits, "row").select("row", "text", "hits").mapInArrow(_window_rows, "row long, length int, at long, hash long")
    found = around.join(windows.select("length", "hash").distinct(), ["length", "hash"], "left_semi")
    places = found.select("row", "hash", F.explode(F.expr("sequence(at, at + length - 1)")).alias("place"))
    hit = places.groupBy("row").agg(F.count_distinct("place").alias("n_hit"), F.collect_set("hash").alias("windows"))
    count = docs.select("row", "text").mapInArrow(_document_rows({}, {}), "doc_id long, n_words long, n_hit long, windows array<long>")
    rows = docs.select("row", "doc_id").join(count.select(F.col("doc_id").alias("row"), "n_words"), "row").join(hit, "row", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("windows", F.expr("array()")).alias("windows"))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, contaminated)``, a row for each row of ``docs``; ``items`` are the sorted ids,
    as strings, of the items with a window that occurs in the text.

    Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. Null and empty texts have no
    words, and items without words no window. Rows with a null id have their row, and so do repeated rows; items with a
    null id mark words but aren't listed. Items of one id are one item. Empty tables on either side: no rows, or rows
    without hits. Columns other than those named are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    schema = "item string, length int, hash long"
    windows, prints = (cut(items.mapInArrow(_item_rows(kind), schema)) for kind in ("windows", "prints"))
    if windows.count() + prints.count() <= broadcast_rows:
        sides = []
        for side in (prints, windows):
            rows = side.select("length", "hash").distinct().toPandas()
            sides.append({int(n): np.sort(g["hash"].to_numpy()) for n, g in rows.groupby("length")})
        rows = docs.mapInArrow(_document_rows(*sides), "doc_id long, n_words long, n_hit long, windows array<long>")
    else:
        rows = _by_shuffle(docs, prints, windows)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    hits = rows.where("n_hit > 0").select("row", F.explode("windows").alias("hash"))
    ids = hits.join(windows.select("hash", "item").distinct(), "hash").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.expr("cast(array() as array<string>)")
    return rows.join(ids, "row", "left").select("doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id isn't contaminated. Rows with a null id stay."""
    out = overlaps(docs, items, id_col, **options).where("contaminated").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(out, F.col(id_col).cast("long") == F.col("__dropped"), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLE = {
    "op8_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from benchmark
), bw as (
  select distinct item_id, n, array_to_string(l[i:i+n-1], ' ') as g
  from (select item_id, l, least(len(l), 10) as n, unnest(range(1, len(l) - least(len(l), 10) + 2)) as i from b where len(l) > 0)
), k as (select distinct n from bw
), dw as (
  select doc_id, n, i, array_to_string(l[i:i+n-1], ' ') as g
  from (select doc_id, l, n, unnest(range(1, len(l) - n + 2)) as i from d, k where len(l) >= n)
), h as (select dw.doc_id, dw.n, dw.i, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g
), c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1
), t as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item from h) group by 1
)
select d.doc_id, len(d.l)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
  coalesce(t.items_sha256, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id""",
}
