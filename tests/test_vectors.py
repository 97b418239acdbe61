"""Approximate neighbours against exact ones."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gristmill.operators import vectors as V
from gristmill.plans import catalog


def exact(ids, rows, wanted, k=10):
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    near = rows[wanted] @ rows.T
    near[np.arange(len(wanted)), wanted] = -2
    return {int(ids[w]): [int(ids[j]) for j in np.lexsort((ids, -near[i]))[:k]] for i, w in enumerate(wanted)}


def recall(got, want):
    return np.mean([len(set(got.get(q, [])) & set(found)) / len(found) for q, found in want.items()])


def listed(frame, column="id"):
    out = {}
    for r in frame.collect():
        out.setdefault(r.q, []).append((r.place, r[column]))
    return {q: [i for _, i in sorted(found)] for q, found in out.items()}


def test_recall_on_the_stored_vectors(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, data = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    got = listed(catalog.QUERIES["ann_topk"](spark, sf_dir), "vec_id")
    want = exact(ids, data, np.flatnonzero(ids % 20 == 0))
    assert got.keys() == want.keys() and {len(x) for x in got.values()} == {10}
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("cell", [V.CELL, 50])
def test_clusters_ties_and_hot_lists(spark, tmp_path, monkeypatch, cell):
    """A third of the rows are one vector; some are zeros or null; small cells split the hot list, blocks split queries."""
    monkeypatch.setattr(V, "CELL", cell)
    monkeypatch.setattr(V, "BLOCK", 10 if cell == 50 else V.BLOCK)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 16))
    data = centres[draw.integers(12, size=600)] + 0.05 * draw.normal(size=(600, 16))
    data[:200] = data[0]
    data[597] = 0
    frame = spark.createDataFrame([(i * 3, None if i == 598 else [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    index, model = V.build(frame, str(tmp_path / "v"))
    assert index.count() == 600 and model.probes < len(model.centres)
    again = V.load(spark, str(tmp_path / "v/model"))
    assert again.probes == model.probes and (again.books == model.books).all()
    got = listed(V.nearest(index, frame, frame.where("vec_id % 20 = 0"), again))
    ids = np.arange(600) * 3
    want = exact(ids, data, np.array([i for i in range(600) if i * 3 % 20 == 0 and i not in (597, 598)]))
    assert set(want) <= set(got)
    tied = {int(i) for i in ids[:200]}
    assert all(set(found) <= tied and len(found) == 10 for q, found in got.items() if q in tied)
    assert recall({q: f for q, f in got.items() if q not in tied}, {q: f for q, f in want.items() if q not in tied}) >= 0.9
    with pytest.raises(ValueError):
        V.fit(frame.limit(0))


def test_cells():
    sizes = {0: 10, 1: V.CELL - 5, 2: 3 * V.CELL + 1, 3: 1}
    first, count = V._cells(sizes, 5)
    assert count == [1, 1, 4, 1, 1] and first[0] == 0 and first[1] == 1 and first[2] == 2 and first[3] == first[4] == 6


def test_exact_neighbours_in_small_blocks(spark, monkeypatch):
    """Copies, equal scores, a zero vector and a null one, over many blocks: the same rows as the plain reckoning, and no
    nested loop over pairs."""
    from gristmill.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 30)
    monkeypatch.setattr(search, "PRODUCTS", 64)
    draw = np.random.default_rng(3)
    data = draw.integers(-3, 4, (200, 4)).astype(float)
    data[40:100] = data[40]
    data[7] = 0
    rows = spark.createDataFrame([(i, None if i == 9 else v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    found = search.exact_nearest(rows, rows.where("vec_id % 20 = 0"), 10)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    want = {}
    for q in range(0, 200, 20):
        score = {}
        for i in set(range(200)) - {q}:
            total = lambda a, b: sum(x * y for x, y in zip(a.tolist(), b.tolist()))
            lengths = np.sqrt(total(data[q], data[q])) * np.sqrt(total(data[i], data[i]))
            score[i] = -2 if i == 9 or not lengths else total(data[q], data[i]) / lengths
        want[q] = sorted(score, key=lambda i: (-score[i], i))[:10]
    got = {q: [] for q in want}
    for r in found.orderBy("q", "n").collect():
        got[r.q].append(r.vec_id)
    assert got == want
    # The ones without a cosine come after all others.
    assert {7, 9} == {r.vec_id for r in search.exact_nearest(rows, rows.where("vec_id = 0"), 199).where("n > 197").collect()}


def test_a_task_is_bounded_by_pieces():
    """What a task makes beside its rows, with as many lists as there may be, a full Arrow batch, a full cell and many queries."""
    draw = np.random.default_rng(3)
    unit = lambda n: draw.standard_normal((n, 32)).astype(np.float32)
    model = V.Model(unit(V.LISTS), unit(256).reshape(4, 256, 8), 40)
    asked = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(unit(10_000)), pa.list_(pa.float32()))], ["q", "v"])
    cell = pa.table({"id": range(V.CELL), "list": pa.array(np.arange(V.CELL) % V.LISTS, pa.int32()), "code": pa.array([c.tobytes() for c in draw.integers(0, 256, (V.CELL, 4)).astype(np.uint8)])})
    queries = pa.table({"q": range(512), "v": asked.column(1).slice(0, 512)})
    for most, work in ((100, lambda: sum(b.num_rows for b in V._sent(model, list(range(V.LISTS)), [1] * V.LISTS)(iter([asked])))), (70, lambda: V._best(model, 80)(cell, queries).num_rows)):
        tracemalloc.start()
        assert work() > 0
        peak = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        assert peak < most, peak
