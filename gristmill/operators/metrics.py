"""Cumulative histograms with quantiles, and rates of counters that reset, over sliding windows.

Both are summed up by steps of the slide first; a window merges its steps, so a row isn't copied into each of its windows.
A step holds what is after its start and up to its end, a window ends with its last step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SECOND = 1_000_000


def _step(at: str, slide: int) -> Column:
    """The end of the step, in microseconds."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return micros + F.pmod(-micros, F.lit(slide * _SECOND))


def _windows(width: int, slide: int) -> Column:
    """The ends of the windows that a step is in."""
    if width % slide:
        raise ValueError("a window must be a whole number of slides")
    return F.explode(F.array(*[F.col("step") + F.lit(i * slide * _SECOND) for i in range(width // slide)]))


def histogram(rows: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """``(keys, counts)``: for each bound how many values are at most it, and last how many there are. Nulls aren't counted;
    NaN is above all bounds."""
    if not bounds or list(bounds) != sorted(set(bounds)):
        raise ValueError("bounds must ascend")
    counts = F.array(*[F.count_if(F.col(value) <= F.lit(float(b))) for b in bounds], F.count(value))
    return rows.groupBy(*keys).agg(counts.alias("counts"))


def merge(histograms: DataFrame, keys: Sequence[str], n_bounds: int) -> DataFrame:
    """Histograms over the same bounds, added by ``keys``."""
    return histograms.groupBy(*keys).agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(n_bounds + 1)]).alias("counts"))


def quantile(counts: Column, bounds: Sequence[float], q: float) -> Column:
    """The quantile, by linear interpolation within its bucket.

    The first bucket begins at 0, or is its bound if that isn't positive; above the highest bound, that bound is the answer.
    Null where nothing was counted.
    """
    if not 0 < q <= 1:
        raise ValueError("a quantile is above 0 and at most 1")
    limits, n = F.array(*[F.lit(float(b)) for b in bounds]), len(bounds)
    rank = F.lit(q) * F.get(counts, F.lit(n))
    i = F.size(F.filter(counts, lambda c: c < rank))
    upper, lower = F.get(limits, i), F.when(i == 0, 0.0).otherwise(F.get(limits, i - 1))
    before = F.when(i == 0, 0).otherwise(F.get(counts, i - 1))
    inside = lower + (upper - lower) * (rank - before) / F.nullif(F.get(counts, i) - before, F.lit(0))
    return F.when(F.get(counts, F.lit(n)) == 0, F.lit(None)).when(i >= n, float(bounds[-1])).when((i == 0) & (upper <= 0), upper).otherwise(inside)


def sliding_histogram(rows: DataFrame, keys: Sequence[str], at: str, value: str, bounds: Sequence[float], width: int, slide: int) -> DataFrame:
    """``(keys, window_end, counts)`` for windows of ``width`` seconds, one each ``slide`` seconds. Rows without a time are left
    out; a null key is a key."""
    steps = histogram(rows.where(F.col(at).isNotNull()).withColumn("step", _step(at, slide)), [*keys, "step"], value, bounds)
    spread = steps.select(*keys, _windows(width, slide).alias("window_end"), "counts")
    return merge(spread, [*keys, "window_end"], len(bounds))


def _follow(a: Column, b: Column) -> Column:
    """The summary of ``a`` and then ``b``: a value that falls between them is a reset, and what came before is kept."""
    fallen = F.when(b["first"]["value"] < a["last"]["value"], a["last"]["value"]).otherwise(0.0)
    return F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["n"] + b["n"]).alias("n"), (a["lost"] + b["lost"] + fallen).alias("lost"))


def counter_rates(samples: DataFrame, keys: Sequence[str], at: str, value: str, width: int, slide: int) -> DataFrame:
    """``(keys, window_end, n, increase, rate)``: the rise of a counter in each window with two samples or more, and its rate a
    second.

    A sample below the one before is a counter that began anew at 0. As samples don't meet a window's edges, the rise is
    extended to an edge less than 1.1 mean gaps away, else by half a gap, and never before the counter was 0. Of samples with
    one key and time the greatest counts; rows without time or value are left out; a null key is a key.

    Samples are ordered by key and step only, in one shuffle; windows join at most width / slide summaries.
    """
    rows = samples.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(*keys, _step(at, slide).alias("step"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value"))
    group = [*keys, "step"]
    rows = rows.repartition(*group).groupBy(*group, "at").agg(F.max("value").alias("value"))
    before = F.lag("value").over(Window.partitionBy(*group).orderBy("at"))
    rows = rows.withColumn("lost", F.when(F.col("value") < before, before).otherwise(0.0))
    sample = F.struct("at", "value")
    steps = rows.groupBy(*group).agg(F.min(sample).alias("first"), F.max(sample).alias("last"), F.count("*").alias("n"), F.sum("lost").alias("lost"))
    part = F.struct("first", "last", "n", "lost")
    found = steps.select(*keys, _windows(width, slide).alias("window_end"), part.alias("part")).groupBy(*keys, "window_end").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = F.reduce(F.slice("parts", 2, width // slide), F.get("parts", F.lit(0)), _follow)
    found = found.select(*keys, "window_end", whole.alias("w")).where("w.n >= 2")
    seconds = lambda micros: micros / F.lit(float(_SECOND))
    increase = F.col("w.last.value") - F.col("w.first.value") + F.col("w.lost")
    sampled = seconds(F.col("w.last.at") - F.col("w.first.at"))
    gap = sampled / (F.col("w.n") - 1)
    edge = lambda d: F.when(d >= 1.1 * gap, gap / 2).otherwise(d)
    head = edge(seconds(F.col("w.first.at") - F.col("window_end")) + F.lit(float(width)))
    zero = F.when((increase > 0) & (F.col("w.first.value") >= 0), sampled * (F.col("w.first.value") / increase))
    factor = (sampled + F.least(head, zero) + edge(seconds(F.col("window_end") - F.col("w.last.at")))) / sampled
    return found.select(*keys, "window_end", F.col("w.n").alias("n"), increase.alias("increase"), (increase * factor / F.lit(float(width))).alias("rate"))
