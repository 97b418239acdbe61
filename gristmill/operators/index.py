"""An inverted index in segments: upsert, delete, bulk, merge, and BM25 read from it.

A segment is a folder of Parquet files that is written once. It holds documents in blocks; a document is known inside by its
block and its place there. For each field and term of a block there is one row with the places and the frequencies, and for
each field of a block one row with its documents' keys and lengths. Rows of terms lie in buckets by the term's hash, sorted
by term, so a query opens the folders of its terms' buckets and skips by the files' statistics. A bucket of a segment is
spread over tasks by block, so a term that is in all documents isn't one task's work.

A later segment hides what earlier ones have under its keys, be it by a new document or by a mark that there is none. The
merge of all segments leaves what is hidden out and is a base: earlier segments aren't read any more. A segment's number is
given from outside, such as a micro-batch's; to write it again gives the same, and one that wasn't finished doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..functions.text import canonical, tokens
from . import search
from .staging import staged

BUCKETS = 64
#: Bytes of words from which a block ends, and documents that a task takes at a time.
BLOCK_BYTES, BATCH = 4 << 20, 1000
#: Live or hidden documents whose marks are broadcast in a merge, a byte each; more are joined by a shuffle.
MARKS = 20_000_000
#: Expansions of a query's words that are broadcast; more are joined by a shuffle.
NEAR = 10_000
_ROWS = "bucket int, field string, term string, block string, places array<int>, counts array<int>, keys array<string>, lengths array<int>, gone boolean"
_DOCS, _GONE = -1, -2
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _blocks(fields: Sequence[str], stems: bool, label: str):
    """From (key, a text of words for each field) to the rows of blocks."""

    def rows(block: str, keys: pa.Array, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        for field, column in zip(fields, texts):
            words = pc.split_pattern(column, " ")
            flat = words.flatten()
            place = np.repeat(np.arange(len(keys)), np.diff(np.asarray(words.offsets)))
            real = pc.not_equal(flat, "")
            flat, place = flat.filter(real), place[np.asarray(real)]
            encoded = flat.dictionary_encode()
            names, codes = encoded.dictionary.to_pylist(), np.asarray(encoded.indices, np.int64)
            if stems:  # each distinct word once
                names, to = np.unique(np.array([stem(w) for w in names], object), return_inverse=True) if names else ([], codes)
                codes = to[codes] if len(codes) else codes
            pairs, counts = np.unique(codes * len(keys) + place, return_counts=True)
            term, at = pairs // max(len(keys), 1), pairs % max(len(keys), 1)
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            offsets = np.r_[starts, len(term)].astype(np.int32)
            n = len(starts)
            lengths = np.bincount(place, minlength=len(keys)).astype(np.int32)
            empty = lambda n, kind: pa.array([None] * n, kind)
            columns = [
                pa.concat_arrays([empty(n, pa.int32()), pa.array([_DOCS], pa.int32())]), pa.array([field] * (n + 1)),
                pa.array([*(str(names[i]) for i in term[starts]), None], pa.string()), pa.array([block] * (n + 1)),
                pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), empty(1, pa.list_(pa.int32()))]),
                pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))), empty(1, pa.list_(pa.int32()))]),
                pa.concat_arrays([empty(n, pa.list_(pa.string())), pa.array([keys.to_pylist()], pa.list_(pa.string()))]),
                pa.concat_arrays([empty(n, pa.list_(pa.int32())), pa.array([lengths.tolist()], pa.list_(pa.int32()))]),
                pa.array([False] * (n + 1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "field", "term", "block", "places", "counts", "keys", "lengths", "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            piece = pa.Table.from_batches(held).combine_chunks()
            columns = [c.chunk(0) for c in piece.columns]
            yield from rows(f"{label}-{part}-{number}", columns[0], [pc.fill_null(c, "") for c in columns[1:]])

        for batch in batches:
            sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(i + 1)), 0), np.int64) for i in range(len(fields)))
            at = 0
            while at < batch.num_rows:
                upto = at + int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES - size)) + 1
                held.append(batch.slice(at, upto - at))
                size += int(sizes[at:upto].sum())
                at = min(upto, batch.num_rows)
                if size >= BLOCK_BYTES:
                    yield from flushed()
                    held, size, number = [], 0, number + 1
        if held:
            yield from flushed()

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys to rows that say that there is no document under them."""
    for batch in batches:
        if batch.num_rows:
            none = [pa.array([None], kind) for kind in (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            keys = pa.array([batch.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([_GONE], pa.int32()), *none, keys, pa.array([None], pa.list_(pa.int32())), pa.array([True])], ["bucket", "field", "term", "block", "places", "counts", "keys", "lengths", "gone"])


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """``fields`` maps fields to boosts. ``stems``: words are indexed and searched by their stems."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float], key: str = "id", stems: bool = True):
        self.spark, self.path, self.fields, self.key, self.stems = spark, path, fields, key, stems

    # --- segments

    def _listed(self) -> list[tuple[int, str]]:
        """(number, folder) of what is read: the last base and the finished segments after it."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
        done = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        found = sorted((int(p.getName().split("-")[1]), p.getName().split("-")[0], p.toString()) for p in done)
        base = max((n for n, kind, _ in found if kind == "base"), default=-1)
        return [(n, place) for n, kind, place in found if n > base or (n == base and kind == "base")]

    def _read(self) -> DataFrame:
        parts = [self.spark.read.schema(_ROWS).parquet(place).withColumn("segment", F.lit(n)) for n, place in self._listed()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{_ROWS}, segment int")

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        rows = rows.withColumn("bucket", F.coalesce("bucket", _bucket(F.col("term"))))
        dealt = rows.repartition(parts, "bucket", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("bucket", "field", "term")
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, min(BATCH, int(before)))  # workers hold a block and a batch
        try:
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}-{number:08d}")
        finally:
            self.spark.conf.set(_BATCH, before)

    def words(self, docs: DataFrame) -> DataFrame:
        """The key and each field's words joined by blanks."""
        docs = docs.select(F.col(self.key).cast("string").alias("key"), *[canonical(F.col(f)).alias(f) for f in self.fields])
        return docs.select("key", *[F.array_join(tokens(F.col(f)), " ").alias(f) for f in self.fields])

    def write(self, number: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """A segment of documents, each key once, and of keys under which there are none any more."""
        out = []
        if upserts is not None:
            out.append(self.words(upserts).mapInArrow(_blocks(list(self.fields), self.stems, f"{number}"), _ROWS))
        if deletes is not None:
            out.append(deletes.select(F.col(self.key).cast("string").alias("key")).distinct().mapInArrow(_marks, _ROWS))
        if out:
            self._write(reduce(DataFrame.unionByName, out), "delta", number)

    def bulk(self, number: int, operations: DataFrame, op: str = "op", order: Sequence[str] = ("seq",)) -> None:
        """A segment of rows of the fields with ``op`` ``upsert`` or ``delete``; the last of a key holds."""
        last = F.max_by(F.struct(op, *self.fields), F.struct(*order)).alias("last")
        rows = staged(operations.groupBy(self.key).agg(last).select(self.key, "last.*"))
        self.write(number, rows.where(F.col(op) == "upsert"), rows.where(F.col(op) == "delete"))

    def applied(self, op: str = "op", order: Sequence[str] = ("seq",)):
        """For ``foreachBatch`` of a stream of operations: the micro-batch's number is the segment's."""
        return lambda rows, number: self.bulk(number, rows, op, order)

    def documents(self) -> DataFrame:
        """(field, key, length, block, place) of what is live: a key's last segment, if it has a document there."""
        rows = self._read().where(F.col("bucket").isin(_DOCS, _GONE))
        rows = rows.select("segment", "field", "block", "gone", F.posexplode(F.arrays_zip("keys", F.coalesce("lengths", F.transform("keys", lambda _: F.lit(0))).alias("lengths"))).alias("place", "d"))
        rows = rows.select("segment", "field", "block", "gone", "place", F.col("d.keys").alias("key"), F.col("d.lengths").alias("length")).where("key is not null")
        if len(self._listed()) < 2:
            return rows.where("not gone").drop("segment", "gone")
        last = rows.groupBy("key").agg(F.max("segment").alias("segment"))
        return rows.join(last, ["key", "segment"]).where("not gone").select("field", "block", "place", "key", "length")

    def count(self) -> int:
        return self.documents().select("key").distinct().count()

    def merge(self, number: int) -> None:
        """A base of all that is live in the segments up to ``number``. Blocks stay; hidden documents leave their rows."""
        listed = [n for n, _ in self._listed()]
        if listed and max(listed) > number:
            raise ValueError(f"segment {max(listed)} is later than {number}")
        rows = self._read().where(F.col("bucket") != _GONE).drop("segment")
        field = next(iter(self.fields))
        live = self.documents().where(F.col("field") == field).select("block", "place", F.lit(True).alias("live"))
        every = rows.where((F.col("bucket") == _DOCS) & (F.col("field") == field)).select("block", F.posexplode("keys").alias("place", "key"))
        # Of each block, place by place, whether its document is live; as long as the block.
        alive = every.join(live, ["block", "place"], "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("live", F.lit(False)).alias("live")))).alias("alive"))
        alive = staged(alive.select("block", F.transform("alive", lambda x: x["live"]).alias("alive")).where(F.array_contains("alive", True)))
        alive = alive.withColumn("whole", ~F.array_contains("alive", False))
        size = alive.agg(F.sum(F.size("alive"))).first()[0] or 0
        rows = rows.join(F.broadcast(alive) if size <= MARKS else alive, "block")
        stays = lambda place: F.element_at("alive", place + 1)
        here = F.filter(F.arrays_zip("places", "counts"), lambda z: stays(z["places"]))
        cut = F.when(F.col("whole"), F.arrays_zip("places", "counts")).otherwise(here)
        # Places stay as they are, so a hidden document's key is emptied and not left out.
        keys = F.when(F.col("whole"), F.col("keys")).otherwise(F.transform("keys", lambda k, i: F.when(stays(i), k)))
        rows = rows.select(F.when(F.col("bucket") < 0, F.col("bucket")).alias("bucket"), "field", "term", "block", F.transform(cut, lambda z: z["places"]).alias("places"), F.transform(cut, lambda z: z["counts"]).alias("counts"), keys.alias("keys"), "lengths", "gone")
        self._write(rows.where("term is null or size(places) > 0"), "base", number)

    # --- searching

    def _expanded(self, words: Sequence[str], fuzzy: bool) -> DataFrame:
        """(word, term, weight): each word's own term, and the terms of the index within its edits."""
        own = self.spark.createDataFrame([(i, w, 1.0) for i, w in enumerate(words)], "word int, term string, weight double")
        if not fuzzy:
            return own
        known = self._read().where(F.col("bucket") >= 0).select("term").distinct()
        close = [search.fuzzy_terms(known, w).where("edits > 0").select(F.lit(i).alias("word"), "term", F.greatest(1 - F.col("edits") / F.least(F.length("term"), F.lit(len(w))), F.lit(0.0)).alias("weight")) for i, w in enumerate(words) if search.edits_allowed(w)]
        found = staged(reduce(DataFrame.unionByName, close, own).where("weight > 0"))
        return F.broadcast(found) if found.count() <= NEAR else found

    def scores(self, words: Sequence[str], fuzzy: bool = False, k1: float = search.K1, b: float = search.B) -> DataFrame:
        """(key, score): the best field's boosted BM25 of the live documents with one of the words (canonical, no stop words).
        All statistics are those of the live documents. No words: no rows."""
        words = sorted({stem(w) if self.stems else w for w in words})
        rows = self._read().where(F.col("bucket") >= 0)
        if not fuzzy and words:  # constants, by which folders and files are passed over
            buckets = self.spark.range(1).select(F.array(*[_bucket(F.lit(w)) for w in words])).first()[0]
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
        rows = rows.join(self._expanded(words, fuzzy), "term")
        rows = rows.select("field", "word", "weight", "block", F.inline(F.arrays_zip("places", "counts")))
        tf = rows.groupBy("field", "word", "block", F.col("places").alias("place")).agg(F.sum(F.col("weight") * F.col("counts")).alias("tf"))
        live = self.documents()
        stats = live.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        hits = staged(tf.join(live, ["field", "block", "place"]).select("field", "word", "key", "length", "tf"))
        df = hits.groupBy("field", "word").agg(F.count("*").alias("df"))
        boosts = F.create_map(*[F.lit(x) for f, boost in self.fields.items() for x in (f, float(boost))])
        # Statistics are a row for each field, and for each field and word.
        hits = hits.join(F.broadcast(stats), "field").join(F.broadcast(df), ["field", "word"])
        part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        by_field = hits.groupBy("key", "field").agg(F.sum(part).alias("part")).select("key", (F.col("part") * boosts[F.col("field")]).alias("part"))
        return by_field.groupBy("key").agg(F.max("part").alias("score"))

    def lexical_leg(self, query: str, fuzzy: bool = True) -> DataFrame:
        """As ``search.lexical_leg``, by the key's text, from the index."""
        return self.scores(search.canonical_words(self.spark, query), fuzzy)
