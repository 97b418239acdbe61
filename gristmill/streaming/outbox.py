"""The outbox's drain: claim, send in order of each key, mark; attempts, poison, and a ledger by batch.

A batch has a number. What it claims is written first, then it is sent, then the ledger's part of that number is written. A
batch that is run again (after a failure at any point, or because the stream's checkpoint is behind) finds its claim and
sends just that under the same number; a sink that replaces what it has under a number, such as ``Log``, then holds each
event once. A batch that is marked is not run again. Events that failed are in the ledger's part and are claimed by the next
batch, until they are sent or poisoned. Events that come once more after they were published are not claimed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``(claimed, number) -> (id, error)``: sends all rows and tells of each why it failed, or null.
Send = Callable[[DataFrame, int], DataFrame]
_EVENT = ["id", "topic", "partition_key", "payload", "occurred_at"]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


@dataclass
class Log:
    """A topic log in a folder, one part for each batch. ``refuses`` gives the error of an event that can't be written."""

    path: str
    refuses: Column | None = None

    def __call__(self, claimed: DataFrame, number: int) -> DataFrame:
        rows = claimed.withColumn("error", F.lit(None).cast("string") if self.refuses is None else self.refuses)
        sent = rows.where("error is null").repartition("topic", "partition_key").sortWithinPartitions("topic", "partition_key", "occurred_at", "id")
        sent.select(*_EVENT).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return rows.select("id", "error")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def kafka(servers: str, **options: str) -> Send:
    """To Kafka, keyed, so that a key's events are in one partition in order; acknowledged by all replicas, without
    duplicates of one producer. Needs Spark's Kafka package. A batch that is sent again is told apart by the header ``id``."""

    def send(claimed: DataFrame, number: int) -> DataFrame:
        rows = claimed.repartition("topic", "partition_key").sortWithinPartitions("topic", "partition_key", "occurred_at", "id")
        rows = rows.select("topic", F.col("partition_key").cast("string").alias("key"), F.col("payload").alias("value"), F.array(F.struct(F.lit("id").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))).alias("headers"))
        rows.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.enable.idempotence": "true", "includeHeaders": "true", **options}).save()
        return claimed.select("id", F.lit(None).cast("string").alias("error"))

    return send


class Outbox:
    """``path`` holds claims and the ledger. ``most`` bounds what a batch claims, oldest first (None: all)."""

    def __init__(self, spark: SparkSession, path: str, send: Send, attempts: int = 10, most: int | None = None):
        self.spark, self.path, self.send, self.attempts, self.most = spark, path, send, attempts, most

    def _part(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/batch={number}"

    def ledger(self) -> DataFrame:
        """A row for each batch in which an event was tried or put off: status published, failed, poisoned or waiting."""
        return self.spark.read.option("basePath", f"{self.path}/ledger").parquet(f"{self.path}/ledger")

    def status(self) -> DataFrame:
        """(id, status, attempts, error, batch) of each event, as of the last batch that had it."""
        last = F.max_by(F.struct("status", "attempts", "error", "batch"), "batch").alias("last")
        return self.ledger().groupBy("id").agg(last).select("id", "last.*")

    def _claim(self, rows: DataFrame, number: int) -> DataFrame:
        spark = rows.sparkSession
        if not _exists(spark, self._part("claims", number)):
            new = rows.select(*_EVENT).dropDuplicates(["id"]).withColumn("attempts", F.lit(0))
            if number:
                before = spark.read.option("basePath", f"{self.path}/ledger").parquet(*[self._part("ledger", n) for n in range(number)])
                new = new.join(before.select("id").distinct(), "id", "left_anti")
                open_ = before.where((F.col("batch") == number - 1) & F.col("status").isin("failed", "waiting"))
                new = new.unionByName(open_.select(*_EVENT, "attempts"))
            if self.most is not None:
                tried = new.orderBy("occurred_at", "id").limit(self.most).select("id", F.lit(True).alias("tried"))
                new = new.join(tried, "id", "left")
            else:
                new = new.withColumn("tried", F.lit(True))
            new.withColumn("tried", F.coalesce("tried", F.lit(False))).write.mode("overwrite").parquet(self._part("claims", number))
        return spark.read.parquet(self._part("claims", number))

    def _mark(self, claimed: DataFrame, outcome: DataFrame, number: int) -> None:
        rows = claimed.join(outcome.select("id", F.substring("error", 1, 1000).alias("error"), F.lit(True).alias("answered")), "id", "left")
        failed = F.col("tried") & (F.col("error").isNotNull() | F.col("answered").isNull())  # no answer is no acknowledgement
        attempts = (F.col("attempts") + failed.cast("int")).alias("attempts")
        status = F.when(~F.col("tried"), "waiting").when(~failed, "published").when(F.col("attempts") + 1 >= self.attempts, "poisoned").otherwise("failed").alias("status")
        rows.select(*_EVENT, status, attempts, "error").write.mode("overwrite").parquet(self._part("ledger", number))

    def drain(self, rows: DataFrame, number: int) -> None:
        """For ``foreachBatch``: one batch of events ``(id, topic, partition_key, payload, occurred_at)``. Batches are numbered
        from 0 without gaps."""
        if _exists(rows.sparkSession, self._part("ledger", number)):
            return
        claimed = self._claim(rows, number)
        self._mark(claimed, self.send(claimed.where("tried"), number), number)

    def drain_rest(self, rows: DataFrame, number: int) -> int:
        """Batches from ``number`` on without new events (``rows`` gives their columns), until none is open; the next number."""
        while True:
            open_ = self.spark.read.parquet(self._part("ledger", number - 1)).where(F.col("status").isin("failed", "waiting"))
            if open_.isEmpty():
                return number
            self.drain(rows.limit(0), number)
            number += 1
