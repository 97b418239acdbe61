"""Streaming forms of the stateful operators. Each takes a streaming (or batch) DataFrame of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.staging import folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

def read(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over Parquet files in a folder, or over one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def kafka(spark: SparkSession, servers: str, topic: str, most: int = 100) -> DataFrame:
    """From the earliest offset, some records at a time; needs Spark's Kafka package."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most).load()


def first_deliveries(events: DataFrame, time: str, key: list[str], delay: str = "1 day") -> DataFrame:
    """Each key once; the state of keys older than the watermark goes."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width, slide), by).agg(F.count("*").alias("n"))


def rate_limit(events: DataFrame, key: str, seconds: str, event_id: str, rate: float, capacity: float) -> DataFrame:
    """(key, event_id, allowed, tokens) of a token bucket per key, whose tokens and clock are its state."""

    def step(key_values: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values([seconds, event_id])
        out = []
        for now, event in zip(rows[seconds], rows[event_id]):
            if last is not None:
                tokens = min(capacity, tokens + max(0.0, now - last) * rate)
            last = now if last is None else max(last, now)
            allowed = tokens >= 1
            tokens -= allowed
            out.append((key_values[0], event, bool(allowed), float(tokens)))
        state.update((float(tokens), float(last)))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "tokens"])

    return events.groupBy(key).applyInPandasWithState(step, "key long, event_id long, allowed boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a snapshot per batch, written beside the one before and never over it. A batch that is run again
    writes the same snapshot again, from the same one before."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/batch={number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_once(stream: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """All that is available now, into a table in the shared folder, which is read back. In the modes complete and update a
    micro-batch's rows replace those before. At the ``place`` of an earlier run it goes on from where that run ended."""
    spark = stream.sparkSession
    place = place or f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{place}/0")  # so that there is a table if nothing comes
    if mode == "append":
        query = writer.format("parquet").option("path", f"{place}/rows").start()
    else:
        query = writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{place}/rows")).start()
    query.awaitTermination()
    rows = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/rows")
    found = rows.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(rows)
    return spark.read.schema(stream.schema).parquet(f"{place}/rows" if found else f"{place}/0")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of several variables needs RocksDB; the session's own setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
