"""Streaming forms: micro-batches over several files against the batch form, and restarts."""

import random

import pytest

from pyspark.sql import functions as F

from gristmill.operators import dedup
from gristmill.streaming import canonical, jobs, outbox


def postings(spark):
    """Copies, near copies, empty texts and a null company; places and levels that differ."""
    draw = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    bases = [[draw.choice(vocabulary) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(240):
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            words[draw.randrange(40)] = draw.choice(vocabulary)
        title = draw.choice(["Senior Software Engineer", "Software Engineer", "Staff Data Engineer, Search", "Product Manager", "Engineering Manager"])
        rows.append((i, draw.choice(["x", "y", None]), title, " ".join(words) if i % 40 else "", draw.choice(["Berlin", "Berlin, Germany", "Paris", ""]), draw.random() < 0.2))
    return spark.createDataFrame(rows, "posting_id long, company string, title string, description string, location string, remote boolean")


def test_canonical_jobs_by_micro_batches(spark, tmp_path):
    rows = postings(spark)
    for start in (0, 1):  # the second start goes on with the state of the first
        for k in (2 * start, 2 * start + 1):
            part = rows.where((F.col("posting_id") >= 60 * k) & (F.col("posting_id") < 60 * (k + 1)))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with jobs.rocksdb(spark):
            got = jobs.run_once(canonical.resolve(jobs.read(spark, str(tmp_path / "in"), files=1)), place=str(tmp_path / "out")).collect()
    want = dedup.canonicalize(dedup.fingerprints(rows)).collect()
    plain = lambda found: {r.posting_id: (r.canonical_id, r.match_score and round(r.match_score, 9)) for r in found}
    assert len(got) == 240 and plain(got) == plain(want)
    assert sum(r.posting_id != r.canonical_id for r in got) > 25
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_canonical_jobs_settled_by_micro_batches(spark, tmp_path):
    """Each micro-batch in one step on all cores, over a restart and a batch that is run again: as all at once."""
    rows = postings(spark)
    place, step = str(tmp_path / "out"), canonical.settle_into(str(tmp_path / "out"))
    for start in (0, 1):
        for k in (2 * start, 2 * start + 1):
            part = rows.where((F.col("posting_id") >= 60 * k) & (F.col("posting_id") < 60 * (k + 1)))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read(spark, str(tmp_path / "in"), files=1)
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    step(part, 3)
    got = canonical.settled(spark, place).collect()
    want = dedup.canonicalize(dedup.fingerprints(rows)).collect()
    plain = lambda found: {r.posting_id: (r.canonical_id, r.match_score and round(r.match_score, 9)) for r in found}
    assert len(got) == 240 and plain(got) == plain(want)
    assert sum(r.posting_id != r.canonical_id and r.canonical_id < 60 <= r.posting_id for r in got) > 10
    assert canonical.settled(spark, str(tmp_path / "none")).count() == 0


class Crash(Exception):
    pass


def events(spark, ids, at=0):
    return spark.createDataFrame([(i, "t", i % 3, f"p{i}", at + i) for i in ids], "id long, topic string, partition_key long, payload string, occurred_at long")


@pytest.mark.parametrize("crash", ["claim", "send", "mark"])
def test_a_batch_that_dies_sends_nothing_twice(spark, tmp_path, crash):
    """The first batch dies after its claim, after it was sent, or after the mark but before the stream's checkpoint."""
    events(spark, range(20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = outbox.Log(str(tmp_path / "log"), F.when(F.col("id") == 7, F.lit("x" * 3000)))
    dies = [True]

    class Fragile(outbox.Outbox):
        def _step(self, name, do, *args):
            out = do(*args)
            if crash == name and dies:
                dies.clear()
                raise Crash
            return out

        def _claim(self, *args):
            return self._step("claim", super()._claim, *args)

        def _mark(self, *args):
            return self._step("mark", super()._mark, *args)

    def send(claimed, number):
        out = log(claimed, number)
        if crash == "send" and dies:
            dies.clear()
            raise Crash
        return out

    def run():
        box = Fragile(spark, str(tmp_path / "box"), send, attempts=3)
        stream = jobs.read(spark, str(tmp_path / "in"), files=1)
        stream.writeStream.foreachBatch(box.drain).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return box

    with pytest.raises(Exception, match="Crash"):
        run()
    events(spark, [3, 4, 20, 21]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # 3 and 4 come again
    box = run()
    assert box.drain_rest(events(spark, [0]), 2) == 3
    sent = [r.id for r in log.read(spark).collect()]
    assert sorted(sent) == [i for i in range(22) if i != 7]
    status = {r.id: (r.status, r.attempts, r.error and len(r.error)) for r in box.status().collect()}
    assert status[7] == ("poisoned", 3, 1000) and all(v == ("published", 0, None) for k, v in status.items() if k != 7)


def test_claims_are_bounded_and_oldest_first(spark, tmp_path):
    log = outbox.Log(str(tmp_path / "log"))
    box = outbox.Outbox(spark, str(tmp_path / "box"), log, most=4)
    box.drain(events(spark, range(10)), 0)
    assert {r.id for r in box.status().where("status = 'published'").collect()} == {0, 1, 2, 3}
    assert box.drain_rest(events(spark, [0]), 1) == 3
    parts = {r.id: r.batch for r in log.read(spark).collect()}
    assert parts == {i: i // 4 for i in range(10)}
    silent = outbox.Outbox(spark, str(tmp_path / "silent"), lambda claimed, number: claimed.select("id", F.lit(None).cast("string").alias("error")).limit(0), attempts=2)
    silent.drain(events(spark, [1]), 0)
    assert silent.drain_rest(events(spark, [0]), 1) == 2 and silent.status().first().status == "poisoned"


def test_event_rate_at_the_ends_of_minutes(spark, tmp_path):
    """The SQL's milliseconds are rounded, so an event of a minute's last 500 microseconds is the next minute's."""
    import duckdb

    from gristmill.plans import catalog

    ends = [f"{day} 10:0{i}:{s}" for i, day in enumerate(("2024-01-01", "2024-01-02", "1969-12-30")) for s in ("00", "00.0005", "30.25", "59.999499", "59.9995", "59.999999")]
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate([*ends, "1969-12-31 23:59:00.0004", "1969-12-31 23:59:59.9996"])], "event_id long, t string, k int")
    rows = rows.selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "event_id as user_id", "concat('type', k) as event_type", "1.0D as value", "'{}' as props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["stream_event_rate"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        want = con.sql(catalog.ORACLES["stream_event_rate"]).fetchall()
    assert sorted(got) == sorted(want) and len(got) > 50
