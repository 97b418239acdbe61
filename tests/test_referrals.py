"""Referral requests over time: a plain fold, the batch form, and the stream over several files and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gristmill.operators import lifecycle
from gristmill.streaming import jobs, referrals

START = datetime(2024, 1, 1)
WEEK = timedelta(days=7)
SCHEMA = "request long, event long, at timestamp, state string, way string, legal int"


def brute(rows, now=None):
    out = []
    whole = {r[:4] for r in rows if None not in r[:4]}
    for request in {r[0] for r in whole}:
        state = deadline = None
        for _, event, at, to in sorted((r for r in whole if r[0] == request), key=lambda r: (r[2], r[1], r[3])):
            if state in ("REQUESTED", "ACCEPTED") and at > deadline:
                out.append((request, None, deadline, state, "EXPIRED", True))
                state = "EXPIRED"
            legal = to in lifecycle.NEXT.get(state, []) if state else to == "REQUESTED"
            out.append((request, event, at, state, to, legal))
            if legal:
                deadline = deadline or at + WEEK
                state = to
        if state in ("REQUESTED", "ACCEPTED") and now and deadline < now:
            out.append((request, None, deadline, state, "EXPIRED", True))
    return sorted(out, key=repr)


def audit(seed):
    """Few requests with many events and many with few; ties in time, redelivered rows, nulls, a request never begun."""
    draw = random.Random(seed)
    states = ["REQUESTED", "ACCEPTED", "SUBMITTED", "DECLINED", "EXPIRED", "CLOSED", "unknown"]
    rows = []
    for i in range(900):
        request = draw.choice([1, draw.randint(2, 250)])
        state = draw.choices(states, [6, 4, 3, 1, 1, 1, 1])[0]
        rows.append((request, i, START + timedelta(hours=i // 2 if draw.random() < 0.8 else 6 * (i // 12)), state, "clash", 1))
    rows += [(7, 900, START, None, "x", 1), (None, 901, START, "REQUESTED", "x", 1), (8, None, START, "REQUESTED", "x", 1), (9, 902, None, "REQUESTED", "x", 1), (300, 903, START, "CLOSED", "x", 1), *rows[:40]]
    return rows


def plain(found, at):
    return sorted(((r.request_id, r.event_id, at(r), r.from_state, r.to_state, r.legal) for r in found), key=repr)


@pytest.mark.parametrize("days", [None, 12])
def test_trace(spark, days):
    rows = audit(1)
    frame = spark.createDataFrame([(*r[:2], r[2], *r[3:]) for r in rows], SCHEMA.replace("at timestamp", "at timestamp_ntz"))
    now = START + timedelta(days=days) if days else None
    got = lifecycle.trace(frame, "request", "event", "at", "state", F.lit(now).cast("timestamp_ntz") if days else None).collect()
    want = brute(rows, now)
    assert plain(got, lambda r: r.at) == want
    assert len({r[3] for r in want}) > 5 and sum(r[1] is None for r in want) > 20
    assert lifecycle.trace(frame.limit(0), "request", "event", "at", "state").count() == 0


def test_legal_steps_are_legal_to_validate_and_expiry_is_that_of_the_sweep(spark):
    frame = spark.createDataFrame(audit(2), SCHEMA)
    now = F.lit("2024-01-13 00:00:00").cast("timestamp")
    rows = lifecycle.trace(frame, "request", "event", "at", "state", now).cache()
    steps = lifecycle.validate(rows.where("legal"), "request_id", ["at", "event_id"], "to_state")
    assert steps.where("not legal").count() == 0
    # Without the timers, the sweep finds the same requests due, save those that a later event had found expired.
    open_now = lifecycle.trace(frame.where(F.col("at") < now), "request", "event", "at", "state").where("legal")
    last = open_now.groupBy(F.col("request_id")).agg(F.max_by("to_state", "at").alias("state"), F.min("at").alias("began"))
    due = lifecycle.expire(last.withColumn("deadline", F.expr("began + interval 7 days")), "state", "deadline", now)
    timed = lifecycle.trace(frame.where(F.col("at") < now), "request", "event", "at", "state", now).where("event_id is null")
    met = open_now.where("event_id is null")
    assert {r.request_id for r in due.collect()} == {r.request_id for r in timed.select("request_id").subtract(met.select("request_id")).collect()} != set()


def test_stream_by_files_and_a_restart(spark, tmp_path):
    rows = [r for r in audit(3) if r[2] is not None]
    latest = max(r[2] for r in rows)
    cuts = [timedelta(days=d) for d in (0, 3, 6, 8, 11, 40)]
    for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if START + start <= r[2] < START + end]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (2, 4):  # two runs; the second goes on with the state and timers of the first
            stream = jobs.read(spark, str(tmp_path / "in"), files=1)
            with jobs.rocksdb(spark):
                got = jobs.run_once(referrals.follow(stream, "request", "event", "at", "state"), place=str(tmp_path / "out")).collect()
    want = brute(rows, latest - timedelta(hours=1))
    at = lambda r: START + timedelta(microseconds=r.at_us - 1_704_067_200_000_000)
    assert plain(got, at) == want
    assert sum(r[1] is None for r in want) > 20


def test_an_ended_request_is_forgotten_after_its_time(spark, tmp_path):
    days = [(0, "REQUESTED"), (1, "DECLINED"), (2, "REQUESTED"), (30, "REQUESTED"), (31, "ACCEPTED")]
    for i, (day, state) in enumerate(days):
        beside = (2, 100 + i, START + timedelta(days=day + 0.5), "unknown", "", 1)  # moves the watermark on
        spark.createDataFrame([(1, i, START + timedelta(days=day), state, "", 1), beside], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with jobs.rocksdb(spark):
            got = jobs.run_once(referrals.follow(jobs.read(spark, str(tmp_path / "in"), files=1), "request", "event", "at", "state", keep="10 days"), place=str(tmp_path / "out")).where("request_id = 1").collect()
    # The fourth finds the request still ended, as its timer fires behind the batch that moves the watermark.
    assert [(r.event_id, r.from_state, r.legal) for r in sorted(got, key=lambda r: r.at_us)] == [(0, None, True), (1, "REQUESTED", True), (2, "DECLINED", False), (3, "DECLINED", False), (4, None, False)]


def test_settled_by_micro_batches(spark, tmp_path):
    """Rounds of joins from the states of the micro-batch before, over a restart, a late event and a batch that is run again."""
    rows = [r for r in audit(3) if r[2] is not None]
    latest = max(r[2] for r in rows)
    place = str(tmp_path / "out")
    step = referrals.settle_into(place, "request", "event", "at", "state")
    cuts = [timedelta(days=d) for d in (0, 3, 6, 8, 11, 40)]
    for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if START + start <= r[2] < START + end]
        part += [(5000, 5000, START, "REQUESTED", "late", 1)] if i == 4 else []
        frame = spark.createDataFrame(part, SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        if i in (2, 4):
            stream = jobs.read(spark, str(tmp_path / "in"), files=1)
            stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    step(frame, 4)
    at = lambda r: START + timedelta(microseconds=r.at_us - 1_704_067_200_000_000)
    want = brute(rows, latest - timedelta(hours=1))
    assert plain(referrals.settled(spark, place).collect(), at) == want
    states = spark.read.parquet(f"{place}/state/batch=4")
    assert states.count() == states.select("request_id").distinct().count() > 100
    assert referrals.settled(spark, str(tmp_path / "none")).count() == 0
