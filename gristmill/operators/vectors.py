"""Approximate nearest neighbours: coarse lists, product codes, exact ranking of what is left.

Centroids and codebooks are fitted on a bounded sample; every row is then coded: the list of its nearest centroid, and a
byte for each part of what it differs by. How many lists a query opens is fitted too: as few as find ``TARGET`` of the true
neighbours within the sample, which is few for clustered vectors and most for vectors without structure.

A search is one cogroup. Lists are packed into cells of about ``CELL`` rows, and a larger list is split over several; a query
goes to the cells of its lists, and a cell's queries are split into blocks. In a cell, codes become vectors again and are
multiplied with the block's queries as matrices. The best ``shortlist`` of each cell, and of these the best of all cells, are
ranked exactly by their own vectors. No side is broadcast, and no task holds more than a cell and a block.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that the fit may see, lists at most, values of a code, rows of a cell, queries of a block.
SAMPLE, LISTS, VALUES, CELL, BLOCK = 20_000, 4096, 256, 32_768, 4096
TARGET = 0.97
#: Rows that are held against all centres at a time, and queries against a cell: what a task needs is bounded by these.
PIECE, ASKED = 1024, 64


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of an array of arrays of numbers; a vector of zeros, or none, stays zeros."""
    width = next((len(x) for x in column if x.is_valid), 1)
    rows = np.array([x if x is not None else [0.0] * width for x in column.to_pylist()], np.float32).reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, PIECE):
            yield batch.slice(a, PIECE)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


def _centres(rows: np.ndarray, count: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """Means of groups by Lloyd's rounds; an empty group starts again at a drawn row."""
    centres = rows[draw.permutation(len(rows))[:count]].copy()
    for _ in range(rounds):
        group = _nearest(rows, centres)
        sizes = np.bincount(group, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, group, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], rows[draw.integers(len(rows), size=len(centres))])
    return centres.astype(np.float32)


@dataclass
class Model:
    centres: np.ndarray
    books: np.ndarray  # parts x values x numbers of a part
    probes: int

    def lists(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows, self.centres)

    def codes(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = (rows - self.centres[at]).reshape(len(rows), len(self.books), -1)
        return np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.centres[at] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)

    def opened(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, : self.probes]


def fit(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", parts: int = 16, neighbours: int = 10, target: float = TARGET, seed: int = 7) -> Model:
    """Of at most ``SAMPLE`` rows, those with the smallest hash of their keys; lists are as many as the root of all rows."""
    total = vectors.count()
    sample = vectors.where(F.col(column).isNotNull()).select(column, F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE).select(column).toArrow()
    if not sample.num_rows:
        raise ValueError("there are no vectors to fit")
    rows = _matrix(sample[column].combine_chunks())
    width = rows.shape[1]
    parts = max(p for p in range(1, min(parts, width) + 1) if width % p == 0)
    draw = np.random.default_rng(seed)
    centres = _centres(rows, int(min(max(round(total**0.5), 1), LISTS, len(rows))), 12, draw)
    at = _nearest(rows, centres)
    rest = (rows - centres[at]).reshape(len(rows), parts, -1)
    books = np.stack([_centres(rest[:, m], min(VALUES, len(rows)), 8, draw) for m in range(parts)])
    tried = draw.permutation(len(rows))[:200]
    near = rows[tried] @ rows.T
    near[np.arange(len(tried)), tried] = -2
    true = np.argsort(-near, axis=1)[:, :neighbours]
    order = np.argsort(np.argsort(-(rows[tried] @ centres.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(np.take_along_axis(order, at[true], axis=1).ravel())  # of each true neighbour: how early its list is opened
    return Model(centres, books, int(depth[min(int(np.ceil(target * len(depth))), len(depth)) - 1]) + 1)


def save(spark: SparkSession, model: Model, path: str) -> None:
    out = io.BytesIO()
    np.savez(out, centres=model.centres, books=model.books, probes=model.probes)
    spark.createDataFrame([(bytearray(out.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    found = np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["model"])))
    return Model(found["centres"], found["books"], int(found["probes"]))


def coded(vectors: DataFrame, model: Model, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(id, list, code)`` of every row; a null vector counts as zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = _matrix(batch.column(1))
            rows = rows if rows.shape[1] == model.centres.shape[1] else np.zeros((len(rows), model.centres.shape[1]), np.float32)
            at = model.lists(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in model.codes(rows, at)], pa.binary())], ["id", "list", "code"])

    return vectors.select(F.col(key).cast("long").alias("id"), column).mapInArrow(run, "id long, list int, code binary")


def _cells(sizes: dict[int, int], lists: int) -> tuple[list[int], list[int]]:
    """Each list's first cell and how many cells it is split over. Small lists share a cell, large ones have their own."""
    first, count, cell, room = [], [], 0, CELL
    for n in (sizes.get(i, 0) for i in range(lists)):
        if n > room and room < CELL:
            cell, room = cell + 1, CELL
        first.append(cell)
        count.append(max(-(-n // CELL), 1))
        if n > CELL:
            cell, room = cell + count[-1], CELL
        else:
            room -= n
    return first, count


def _sent(model: Model, first: list[int], count: list[int]):
    """Queries with the cells of the lists that they open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            cells = [sorted({c for i in of for c in range(first[i], first[i] + count[i])}) for of in model.opened(_matrix(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))], ["q", "v", "cells"])

    return run


def _best(model: Model, shortlist: int):
    """The best of a cell for each query of a block that opens their lists."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [], [], []
        if rows.num_rows and queries.num_rows:
            ids, at = np.asarray(rows["id"]), np.asarray(rows["list"])
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, at = ids[order], at[order]
            vectors = model.decoded(codes[order], at)
            own = np.asarray(queries["q"])
            wanted = _matrix(queries["v"].combine_chunks())
            for a in range(0, len(own), ASKED):
                part = wanted[a : a + ASKED]
                opened = np.zeros((len(part), len(model.centres)), bool)
                np.put_along_axis(opened, model.opened(part), True, axis=1)
                scores = np.where(opened[:, at] & (own[a : a + ASKED, None] != ids), part @ vectors.T, -np.inf)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :shortlist] if scores.shape[1] <= 4 * shortlist else np.argpartition(-scores, shortlist, axis=1)[:, :shortlist]
                found = np.take_along_axis(scores, top, axis=1)
                q, place = np.nonzero(np.isfinite(found))
                for values, of in zip((own[a : a + ASKED][q], ids[top[q, place]], found[q, place]), out):
                    of.append(values)
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"q": join(out[0], pa.int64()), "id": join(out[1], pa.int64()), "near": join(out[2], pa.float64())})

    return run


def _ranked(k: int):
    def run(found: pa.Table, queries: pa.Table) -> pa.Table:
        q = queries["q"][0].as_py() if queries.num_rows else None
        if q is None or not found.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "place": pa.array([], pa.int32())})
        ids = np.asarray(found["id"])
        wanted = np.array(queries["v"][0].as_py(), np.float64)
        rows = np.array([v or [0.0] * len(wanted) for v in found["vec"].to_pylist()], np.float64)
        norms = np.linalg.norm(rows, axis=1) * np.linalg.norm(wanted)
        scores = rows @ wanted / np.where(norms > 0, norms, 1)
        order = np.lexsort((ids, -scores))[:k]
        return pa.table({"q": pa.array([q] * len(order), pa.int64()), "id": pa.array(ids[order], pa.int64()), "score": pa.array(scores[order], pa.float64()), "place": pa.array(range(1, len(order) + 1), pa.int32())})

    return run


def nearest(index: DataFrame, vectors: DataFrame, queries: DataFrame, model: Model, k: int = 10, shortlist: int = 80, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(q, id, score, place)``: the ``k`` nearest by cosine of each row of ``queries``, without itself, ties by id. ``index`` is
    what ``coded`` made of ``vectors`` and should be stored or staged; keys are unique."""
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list, LISTS at most
    first, count = _cells(sizes, len(model.centres))
    first_of, count_of = (F.array(*[F.lit(x) for x in xs]) for xs in (first, count))
    asked = queries.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(column).alias("v"))
    blocks = max(-(-asked.count() // BLOCK), 1)
    # A list's queries are no more than all queries, so blocks of them bound a cell's.
    rows = index.select("id", "list", "code", (F.element_at(first_of, F.col("list") + 1) + F.pmod(F.xxhash64("id"), F.element_at(count_of, F.col("list") + 1))).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    sent = asked.mapInArrow(_sent(model, first, count), f"q long, v {asked.schema['v'].dataType.simpleString()}, cells array<int>")
    sent = sent.select("q", "v", F.explode("cells").alias("cell"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"))
    close = rows.groupBy("cell", "block").cogroup(sent.groupBy("cell", "block")).applyInArrow(_best(model, shortlist), "q long, id long, near double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))
    close = close.withColumn("n", place).where(F.col("n") <= shortlist).select("q", "id")
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vec"))
    return close.join(own, "id").groupBy("q").cogroup(asked.groupBy("q")).applyInArrow(_ranked(k), "q long, id long, score double, place int")


def build(vectors: DataFrame, path: str, column: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, Model]:
    """The codes and the model, stored in a folder."""
    spark = vectors.sparkSession
    model = fit(vectors, column, key)
    save(spark, model, f"{path}/model")
    coded(vectors, model, column, key).write.mode("overwrite").parquet(f"{path}/codes")
    return spark.read.parquet(f"{path}/codes"), model
