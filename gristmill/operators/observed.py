"""Counters and timers that are taken as rows pass by, without a job of their own.

The measures of each outcome are aggregates that Spark observes on the way to a sink, in batch and in each micro-batch, so
they are exact whatever the sink does with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "outcome string, n long, total double, counts array<long>"


def measures(outcome: str, outcomes: Sequence[str], timer: str, bounds: Sequence[float]) -> list[Column]:
    """For each outcome how many rows there are, the sum of their timer, and its cumulative histogram over ``bounds``. Other
    outcomes and null count under ``other``."""
    known, out = F.col(outcome).isin(list(outcomes)), []
    for i, name in enumerate([*outcomes, None]):
        mine = F.coalesce(F.col(outcome) == name, F.lit(False)) if name is not None else ~F.coalesce(known, F.lit(False))
        value = F.when(mine, F.col(timer))
        out += [F.count_if(mine).alias(f"{i}_n"), F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias(f"{i}_total"), F.count(value).alias(f"{i}_{len(bounds)}")]
        out += [F.count_if(value <= F.lit(float(b))).alias(f"{i}_{j}") for j, b in enumerate(bounds)]
    return out


def _rows(found: dict, outcomes: Sequence[str], n_bounds: int) -> list[tuple]:
    return [(name, found.get(f"{i}_n", 0), found.get(f"{i}_total", 0.0), [found.get(f"{i}_{j}", 0) for j in range(n_bounds + 1)]) for i, name in enumerate([*outcomes, "other"])]


def observe(rows: DataFrame, name: str, outcome: str, outcomes: Sequence[str], timer: str, bounds: Sequence[float]) -> tuple[DataFrame, Observation | None]:
    """``rows`` unchanged, to be written once, and what tells their measures then; a stream tells a ``Counters`` instead."""
    columns = measures(outcome, outcomes, timer, bounds)
    if rows.isStreaming:
        return rows.observe(name, *columns), None
    seen = Observation(name)
    return rows.observe(seen, *columns), seen


def told(spark: SparkSession, seen: Observation, outcomes: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """``(outcome, n, total, counts)``, a row for each outcome and one for ``other``. It waits for the action that writes."""
    return spark.createDataFrame(_rows(seen.get, outcomes, len(bounds)), SCHEMA)


class Counters(StreamingQueryListener):
    """The sums of what the streams that observe under ``name`` told. A batch that is told again counts once. It holds two
    rows a stream, however long the stream runs."""

    def __init__(self, name: str, outcomes: Sequence[str], bounds: Sequence[float]):
        self.name, self.outcomes, self.bounds = name, list(outcomes), list(bounds)
        self._streams: dict[str, tuple[int, dict, dict]] = {}
        self._lock = Lock()

    def add(self, stream: str, batch: int, row: Row | dict) -> None:
        new = row.asDict() if isinstance(row, Row) else dict(row)
        with self._lock:
            last, before, current = self._streams.get(stream, (-1, {}, {}))
            if batch > last:
                before = {k: before.get(k, 0) + v for k, v in current.items()} if current else before
                last = batch
            elif batch < last:
                return
            self._streams[stream] = (last, before, new)

    def totals(self) -> list[tuple]:
        with self._lock:
            sums: dict = {}
            for _, before, current in self._streams.values():
                for part in (before, current):
                    for k, v in part.items():
                        sums[k] = sums.get(k, 0) + v
        return _rows(sums, self.outcomes, len(self.bounds))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.add(str(event.progress.id), event.progress.batchId, found)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
