"""Operator 9: toxicity by cumulative-link ordinal regression on sparse word features.

Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. The model is
``P(grade >= k) = logistic(x . w - cut_k)``: one weight vector for all thresholds, with ``cut_1 < cut_2``. Features are
the distinct words of a text (A-Z lower-cased) and the first ``STEM`` bytes of its longer words, known by their 64-bit
hashes. Of these the fit keeps at most ``FEATURES``, those whose association with a threshold is beyond ``Z`` standard
errors. The output is the expected severity, ``P(grade >= 1) + P(grade >= 2)``, between 0 and 2.

A text is rejected from the model's own cut on. One sampled row in ``HELD``, by a hash of its id, is kept out of screening
and fitting, and the cut is where the share of toxic held-out rows that it catches, less ``ALARM`` times the share of
clean ones that it rejects, is greatest; in the middle of the gap between the scores there.

The fit takes a bounded sample of labelled rows: the ``SAMPLE`` rows of documents with labels that have the smallest
hashes of their ids. This is the only bound; scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .shared import cut, table

SAMPLE, FEATURES, Z, SEEN, PENALTY = 12_000, 512, 3.5, 4, 2e-3
STEM, HELD, ALARM = 4, 4, 10
#: Where nothing is held out to choose a cut by.
REJECT = 0.5


def _texts_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of stems, and where each text's begin among them."""
    data = V.LOWER[data]
    starts, ends, bounds = V.words(data, offsets, V.ALNUM)
    hashes = V.word_hashes(data, starts, ends)
    long = np.flatnonzero(ends - starts > STEM)
    stems = V.mix(V.word_hashes(data, starts[long], starts[long] + STEM) + np.uint64(STEM))
    before = np.r_[0, np.cumsum(ends - starts > STEM)]
    order = np.argsort(np.r_[np.arange(len(starts)) * 2, long * 2 + 1], kind="stable")
    return np.r_[hashes, stems][order], bounds + before[bounds]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in V.slices(batch.column(2)):
            hashes, bounds = _texts_features(data, offsets)
            sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "grade", "features"])


@dataclass(frozen=True)
class Ordinal:
    """Sorted feature hashes, their weights, the two cut points, and the expected severity from which texts are rejected."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    reject: float = REJECT

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def _screened(rows: DataFrame) -> np.ndarray:
    """The sorted features of ``rows(grade, features)`` that a threshold's association keeps; counted where the rows are."""
    n, *hits = rows.agg(F.count("*"), *[F.count(F.when(F.col("grade") >= k, 1)) for k in (1, 2)]).first()
    seen = rows.select("grade", F.explode("features").alias("feature")).groupBy("feature")
    seen = seen.agg(F.count("*").alias("seen"), *[F.count(F.when(F.col("grade") >= k, 1)).alias(f"hit_{k}") for k in (1, 2)]).where(F.col("seen") >= SEEN)
    scores = [F.abs(F.col(f"hit_{k}") - F.col("seen") * (hit / n)) / F.sqrt(F.col("seen") * (hit / n * (1 - hit / n))) for k, hit in zip((1, 2), hits) if 0 < hit < n]
    if not scores:
        return np.zeros(0, np.int64)
    best = seen.select("feature", F.greatest(*scores, F.lit(0.0)).alias("best")).where(F.col("best") >= Z)
    return np.sort(np.array([r[0] for r in best.orderBy(F.desc("best"), "feature").limit(FEATURES).collect()], np.int64))


def fit(grades: np.ndarray, owner: np.ndarray, at: np.ndarray, names: np.ndarray, steps: int = 600) -> Ordinal:
    """Penalised maximum likelihood by accelerated gradient steps: row ``owner[i]`` has the feature ``names[at[i]]``, each
    pair once. No rows, or no toxic rows: nothing is rejected."""
    if not len(grades) or not (grades > 0).any():
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.array([40.0, 40.0]))
    n, m = len(grades), len(names)
    times = lambda w: np.bincount(owner, w[at], n) if m else np.zeros(n)
    back = lambda r: np.bincount(at, r[owner], m) if m else np.zeros(0)
    rates = [np.clip((grades >= k).mean(), 1e-4, 1 - 1e-4) for k in (1, 2)]
    first, second = (-np.log(r / (1 - r)) for r in rates)
    state = np.r_[np.zeros(m), first, np.log(max(second - first, 1e-3))]
    top, vector = 1.0, np.ones(m)
    for _ in range(30 if m else 0):  # the largest eigenvalue, for the length of steps
        vector = back(times(vector / np.linalg.norm(vector)))
        top = np.linalg.norm(vector)
    scale = 0.25 * top * 1.05 / n + 2
    momentum, last = state.copy(), state.copy()
    for t in range(steps):
        w, c1, g = momentum[:-2], momentum[-2], momentum[-1]
        c2 = c1 + np.exp(g)
        s = times(w)
        p1, p2 = (1 / (1 + np.exp(-np.clip(s - c, -40, 40))) for c in (c1, c2))
        d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
        chance = np.maximum(np.where(grades == 0, 1 - p1, np.where(grades == 1, p1 - p2, p2)), 1e-9)
        by1 = np.where(grades == 0, d1, np.where(grades == 1, -d1, 0)) / chance / n
        by2 = np.where(grades == 1, d2, np.where(grades == 2, -d2, 0)) / chance / n
        slope = np.r_[back(by1 + by2) + PENALTY * w, -(by1 + by2).sum(), -by2.sum() * np.exp(g)]
        state = momentum - slope / scale
        momentum = state + t / (t + 3) * (state - last)
        last = state
    return Ordinal(names, state[:-2], np.array([state[-2], state[-2] + np.exp(state[-1])]))


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of the greatest share of toxic rows from it on, less ``ALARM`` times that of others. Without toxic rows, or
    if none pays, ``REJECT``."""
    if not toxic.any():
        return REJECT
    order = np.argsort(-severity, kind="stable")
    value = np.cumsum(toxic[order]) / toxic.sum() - ALARM * np.cumsum(~toxic[order]) / max((~toxic).sum(), 1)
    sorted_ = severity[order]
    ends = np.flatnonzero(np.r_[sorted_[:-1] > sorted_[1:], True])
    end = ends[np.argmax(value[ends])]
    if value[end] <= 0:
        return REJECT
    below = sorted_[end + 1] if end + 1 < len(sorted_) else 0.0
    return float((sorted_[end] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fits on the labelled rows of ``docs(doc_id, text)``. Labels with a null id or a null ``toxic`` are left out; a
    null ``quality`` counts as good; of repeated labels the most toxic and the lowest quality count. Of documents that
    share an id the text that sorts first counts."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    grade = F.expr("case when toxic <= 0 then 0 when quality > 0 then 1 else 2 end").alias("grade")
    labelled = labels.select("doc_id", grade).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = cut(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    rows = cut(rows.mapInArrow(_feature_rows, "doc_id long, grade int, features array<long>"))
    fitted = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD)) != 0
    names = _screened(rows.where(fitted))
    kept = F.array_intersect("features", F.array(*[F.lit(int(x)) for x in names])) if len(names) else F.expr("cast(array() as array<long>)")
    got = sorted(rows.select("doc_id", "grade", kept, fitted).collect())
    grades, of = np.array([r[1] for r in got], np.int64), np.array([r[3] for r in got], bool)
    owner = np.repeat(np.arange(len(got)), [len(r[2]) for r in got])
    at = np.searchsorted(names, np.array([x for r in got for x in r[2]], np.int64))
    inner, number = of[owner], np.cumsum(of) - 1
    model = fit(grades[of], number[owner[inner]], at[inner], names)
    if not len(model.features):
        return model
    score = np.bincount(owner, model.weights[at], len(got))[~of]
    return Ordinal(model.features, model.weights, model.cuts, best_cut(model.at_least(score).sum(axis=1), grades[~of] > 0))


def _score_rows(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in V.slices(batch.column(1)):
                hashes, bounds = _texts_features(data, offsets)
                score = np.zeros(hi - lo)
                if len(model.features) and len(hashes):
                    hashes = hashes.view(np.int64)
                    at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
                    hit = np.flatnonzero(model.features[at] == hashes)
                    owner = np.searchsorted(bounds, hit, "right") - 1
                    pairs = np.unique(owner * len(model.features) + at[hit])
                    score = np.bincount(pairs // len(model.features), weights=model.weights[pairs % len(model.features)], minlength=hi - lo)
                chance = model.at_least(score)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(chance[:, 0]), pa.array(chance[:, 1])], ["doc_id", "p_toxic", "p_severe"])

    return run


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, reject: float | None = None) -> DataFrame:
    """``(doc_id, p_toxic, p_severe, expected_severity, grade, rejected)``, a row for each row of ``docs``.

    ``rejected``: the expected severity is at least ``reject``, or without it at least the cut that the model chose.
    ``grade`` is the likeliest grade. A null or empty text has no features and gets the base rate. Rows with null or
    repeated ids have their rows. Empty documents: no rows. No labels: severity 0. Only the named columns are read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(docs, labels, sample)
    rows = docs.mapInArrow(_score_rows(model), "doc_id long, p_toxic double, p_severe double")
    expected = F.col("p_toxic") + F.col("p_severe")
    grade = F.expr("case when 1 - p_toxic >= greatest(p_toxic - p_severe, p_severe) then 0 when p_toxic - p_severe >= p_severe then 1 else 2 end")
    return rows.select("doc_id", "p_toxic", "p_severe", expected.alias("expected_severity"), grade.alias("grade"), (expected >= (model.reject if reject is None else reject)).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id isn't rejected. Rows with a null id stay."""
    out = severity(docs, labels, id_col, **options).where("rejected").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(out, F.col(id_col).cast("long") == F.col("__dropped"), "left_anti")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE: dict[str, str] = {}
