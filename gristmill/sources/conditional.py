"""Conditional fetches as a Spark data source.

A crawl sends each board the validators that it gave last time; a board that hasn't changed answers 304 without a body. Here
responses are files: ``store`` deals boards and responses into buckets by the hash of their address, and the source
``stored_fetches`` reads each bucket as one task. An equality or a list on ``bucket``, and an equality on ``uri``, reach the
source and leave only the buckets that can match.
"""

from __future__ import annotations

import calendar
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Boards of a bucket, whose validators one task holds.
BUCKET_ROWS = 20_000
#: Responses that a task holds at once.
BATCH_ROWS = 64
SCHEMA = "uri string, bucket int, outcome string, status int, etag string, last_modified timestamp, body string, error string"
_ARROW = pa.schema([("uri", pa.string()), ("bucket", pa.int32()), ("outcome", pa.string()), ("status", pa.int32()), ("etag", pa.string()), ("last_modified", pa.timestamp("us", "UTC")), ("body", pa.string()), ("error", pa.string())])
_MONTHS = {name: number for number, name in enumerate(calendar.month_abbr) if number}
_DATE = re.compile(r"(\d{2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}):(\d{2}):(\d{2}) GMT")


def http_date(text: str | None) -> datetime | None:
    """The instant of a Last-Modified header; null where it can't be read. The weekday isn't looked at, as many servers send a
    wrong one; a day beyond its month's end is the last of it."""
    found = _DATE.fullmatch((text or "").strip().split(", ", 1)[-1])
    if not found or found[2] not in _MONTHS:
        return None
    year, month, day = int(found[3]), _MONTHS[found[2]], int(found[1])
    try:
        day = min(day, calendar.monthrange(year, month)[1]) if day <= 31 else day
        return datetime(year, month, day, *(int(found[i]) for i in (4, 5, 6)), tzinfo=timezone.utc)
    except ValueError:
        return None


def answer(etag: str | None, since: datetime | None, response: dict | None) -> tuple[str, int, str | None, datetime | None, str | None, str | None]:
    """(outcome, status, etag, last modified, body, error) of a request with the validators ``etag`` and ``since``.

    No response is a failure with status 0, one of 400 and above a failure. A tag that isn't blank decides alone; the time
    counts, in whole seconds, only without one.
    """
    if response is None:
        return "FAILED", 0, None, None, None, "no response"
    status = response["status"] or 0
    if status == 0 or status >= 400:
        return "FAILED", status, None, None, None, f"board returned HTTP {status}" if status else "no status"
    modified = http_date(response["last_modified"])
    if etag and etag.strip():
        same = etag == response["etag"]
    else:
        same = since is not None and modified is not None and modified <= since
    if same or status == 304:
        return "NOT_MODIFIED", 304, None, None, None, None
    return "FETCHED", status, response["etag"], modified, response["body"] or "", None


def bucket_of(uri: str, buckets: int) -> int:
    return zlib.crc32(uri.encode()) % buckets


class Bucket(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class StoredReader(DataSourceReader):
    def __init__(self, path: str, buckets: int):
        self.path, self.buckets, self.wanted = path, buckets, set(range(buckets))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("bucket",):
                self.wanted &= {f.value} if isinstance(f, EqualTo) else set(f.value)
                continue
            if isinstance(f, EqualTo) and f.attribute == ("uri",):
                self.wanted &= {bucket_of(f.value, self.buckets)}
            yield f

    def partitions(self) -> list[Bucket]:
        return [Bucket(n) for n in sorted(self.wanted)]

    def _batches(self, kind: str, number: int, rows: int) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        place = f"{self.path}/{kind}/bucket={number}"
        system, place = fs.FileSystem.from_uri(place) if re.match(r"\w+:/", place) else (fs.LocalFileSystem(), place)
        if system.get_file_info(place).type == fs.FileType.NotFound:
            return
        yield from dataset.dataset(place, format="parquet", filesystem=system).to_batches(batch_size=rows, batch_readahead=0, fragment_readahead=0)

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        number, asked = partition.number, {}
        for batch in self._batches("boards", number, BUCKET_ROWS):
            for row in batch.to_pylist():
                since = row["last_modified"]  # UTC, with or without the zone, by how Spark writes timestamps
                asked[row["uri"]] = (row["etag"], since and since.replace(tzinfo=timezone.utc))
        for batch in self._batches("responses", number, BATCH_ROWS):
            rows = [(r["uri"], number, *answer(*asked.pop(r["uri"]), r)) for r in batch.to_pylist() if r["uri"] in asked]
            if rows:
                yield _batch(rows)
        if asked:
            yield _batch([(uri, number, *answer(*validators, None)) for uri, validators in asked.items()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)


class StoredFetches(DataSource):
    """Options ``path`` (what ``store`` wrote; a URI that Arrow opens, or a path that all executors share) and ``buckets``."""

    @classmethod
    def name(cls) -> str:
        return "stored_fetches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoredReader:
        return StoredReader(self.options["path"], int(self.options["buckets"]))


def store(boards: DataFrame, responses: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write ``boards(uri, etag, last_modified)`` and ``responses(uri, status, etag, last_modified, body)`` under ``path`` and
    return the number of buckets, by default one for ``BUCKET_ROWS`` boards.

    Rows without an address are left out; of rows with one address the greatest is kept, compared by the columns in this
    order, and that is settled before rows are dealt into buckets. Further columns are ignored.
    """
    if buckets is None:
        buckets = max(1, -(-boards.count() // BUCKET_ROWS))
    at = F.pmod(F.crc32(F.col("uri").cast("binary")), F.lit(buckets)).cast("int")
    for kind, rows, rest in (("boards", boards, ["last_modified", "etag"]), ("responses", responses, ["status", "etag", "last_modified", "body"])):
        rows = rows.where("uri is not null").groupBy("uri").agg(F.max(F.struct(*rest)).alias("r")).select("uri", "r.*", at.alias("bucket"))
        if kind == "boards":
            rows = rows.withColumn("last_modified", F.date_trunc("second", F.col("last_modified").cast("timestamp")))
        rows.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/{kind}")
    return buckets


def fetches(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A row for each board: NOT_MODIFIED, FETCHED with body and new validators, or FAILED with status and error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredFetches)
    return spark.read.format("stored_fetches").option("path", path).option("buckets", str(buckets)).load()
