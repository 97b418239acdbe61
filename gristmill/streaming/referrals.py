"""Referral requests in a stream: the state machine in keyed state, with event-time timers that expire requests.

A request's state is where it is and until when it may stay there. When it begins, a timer is set at its deadline; it fires
as the watermark passes it, and is taken off once the request is submitted or ended. An event that comes after the
deadline in event time finds the request expired, whether or not the timer has fired by then, so what comes out doesn't
depend on how the stream is cut into micro-batches. An ended request's state goes at a later timer.

Each request costs Python calls to its state. ``settle_into`` is the form for micro-batches that bring many events: rounds of
minima and joins as in ``lifecycle.trace``, from the states that the micro-batch before has left in a folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import lifecycle
from ..operators.staging import staged

_MS = 1000
_SCHEMA = "request_id long, event_id long, at_us long, from_state string, to_state string, legal boolean"
_COLUMNS = ["request_id", "event_id", "at_us", "from_state", "to_state", "legal"]


class Referrals(StatefulProcessor):
    def __init__(self, expiry_us: int, keep_us: int):
        self.expiry_us, self.keep_us = expiry_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("referral", "state string, deadline long, timer long")

    def _timer(self, before: int | None, at_us: int | None) -> int | None:
        """Sets the key's one timer behind ``at_us`` in place of the one ``before``."""
        after = None if at_us is None else at_us // _MS + 1
        if after != before:
            if before is not None:
                self._handle.deleteTimer(before)
            if after is not None:
                self._handle.registerTimer(after)
        return after

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, deadline, timer = self._state.get() if self._state.exists() else (None, None, None)
        begun, out = (state, deadline), []
        batch = pd.concat(list(rows)).drop_duplicates().sort_values(["at_us", "event_id", "to_state"], kind="stable")
        ended = None
        for event_id, at_us, to_state in zip(batch["event_id"], batch["at_us"], batch["to_state"]):
            if state in lifecycle.OPEN and at_us > deadline:
                out.append((key[0], None, deadline, state, "EXPIRED", True))
                state, ended = "EXPIRED", deadline
            legal = to_state in (lifecycle.NEXT.get(state, []) if state else ["REQUESTED"])
            out.append((key[0], event_id, at_us, state, to_state, legal))
            if legal:
                deadline = at_us + self.expiry_us if state is None else deadline
                state, ended = to_state, at_us
        if state is not None and (state, deadline) != begun:
            timer = self._timer(timer, deadline if state in lifecycle.OPEN else ended + self.keep_us if state in lifecycle.TERMINAL else None)
            self._state.update((state, deadline, timer))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, deadline, _ = self._state.get()
        if state in lifecycle.OPEN:
            self._state.update(("EXPIRED", deadline, self._timer(None, deadline + self.keep_us)))
            yield _frame([(key[0], None, deadline, state, "EXPIRED", True)])
        else:
            self._state.clear()
            yield _frame([])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"request_id": "int64", "event_id": "Int64", "at_us": "int64", "legal": "bool"})


def follow(audit: DataFrame, request: str, event: str, at: str, state: str, expiry: str = lifecycle.EXPIRY, delay: str = "1 hour", keep: str = "365 days") -> DataFrame:
    """As ``lifecycle.trace`` for a stream, ``at`` a timestamp; to be written in append mode with RocksDB as the state store.

    ``now`` is the watermark, ``delay`` behind the latest event. Events later than that are dropped by the engine, so
    ``delay`` is how late an event may be. An ended request is forgotten ``keep`` after its end. A redelivered event counts
    once within a micro-batch; deduplicate the stream first (``jobs.first_deliveries``) if it can come in a later one.
    """
    us = lambda span: int(pd.Timedelta(span) / pd.Timedelta("1us"))
    rows = audit.select(F.col(request).cast("long").alias("request_id"), F.col(event).cast("long").alias("event_id"), F.col(at).alias("at"), F.col(state).alias("to_state"))
    rows = rows.where("request_id is not null and event_id is not null and at is not null and to_state is not null")
    rows = rows.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    return rows.groupBy("request_id").transformWithStateInPandas(statefulProcessor=Referrals(us(expiry), us(keep)), outputStructType=_SCHEMA, outputMode="append", timeMode="EventTime")


def settle_into(path: str, request: str, event: str, at: str, state: str, expiry: str = lifecycle.EXPIRY, delay: str = "1 hour", keep: str = "365 days") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of an audit as ``follow`` takes it: ``path``/rows has what ``follow`` gives, ``path``/state where each request
    is, both in a folder for each micro-batch. One that is run again writes the same, from what those before have left.

    ``now`` is ``delay`` behind the latest event of all micro-batches, this one included; requests whose deadline is before it
    expire, and the next micro-batch's events that aren't after it are dropped. Each micro-batch writes all states anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = lifecycle.audited(batch.select(F.col(request).cast("long").alias("r"), F.col(event).cast("long").alias("e"), F.col(at).cast("timestamp").alias("t"), F.col(state).alias("s")), "r", "e", "t", "s")
        behind = lambda us: F.timestamp_micros(F.lit(us)) - F.expr(f"interval {delay}")
        seen = spark.read.parquet(f"{path}/seen/batch={number - 1}").first()[0] if number else None
        if seen is not None:
            rows = rows.where(F.col("at") > F.date_trunc("millisecond", behind(seen)))
        rows = staged(rows)
        latest = max((x for x in (seen, rows.agg(F.unix_micros(F.max("at"))).first()[0]) if x is not None), default=None)
        before = spark.read.parquet(f"{path}/state/batch={number - 1}") if number else None
        now = None if latest is None else behind(latest)
        known = staged(lifecycle.ways(rows, now, expiry, before))
        lifecycle.met(rows, known).withColumn("at", F.unix_micros("at")).withColumnRenamed("at", "at_us").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        left = known.where("ends is not null").select("request_id", F.when(F.col("expired_at").isNotNull(), F.lit("EXPIRED")).otherwise(F.col("ends")).alias("state"), "deadline", F.coalesce("expired_at", F.element_at("way", -1)["at"]).alias("ended"))
        if before is not None:
            left = left.join(before.select("request_id", F.col("ended").alias("earlier")), "request_id", "left").withColumn("ended", F.coalesce("ended", "earlier")).drop("earlier")
        if now is not None:
            left = left.where(~F.col("state").isin(lifecycle.TERMINAL) | (F.col("ended") + F.expr(f"interval {keep}") >= now))
        left.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return write


def settled(spark: SparkSession, path: str) -> DataFrame:
    """What ``settle_into`` has written of all micro-batches; none, if none came."""
    spark.createDataFrame([], _SCHEMA).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")
    return spark.read.schema(f"{_SCHEMA}, batch long").parquet(f"{path}/rows").drop("batch")
