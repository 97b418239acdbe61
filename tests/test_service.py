"""Conditional scans, quotas with refunds, histograms and rates against plain forms."""

import math
import random
import time
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gristmill.operators import ingest, metrics, observed, quota
from gristmill.sources import conditional

START = datetime(2024, 1, 1)


def utc(*a):
    return datetime(*a, tzinfo=timezone.utc)


def test_http_dates():
    assert conditional.http_date("Mon, 14 Feb 2024 10:00:01 GMT") == utc(2024, 2, 14, 10, 0, 1)  # a Wednesday
    assert conditional.http_date(" 14 Feb 2024 10:00:01 GMT ") == utc(2024, 2, 14, 10, 0, 1)
    assert conditional.http_date("Sat, 31 Feb 2023 00:00:00 GMT") == utc(2023, 2, 28)
    for text in (None, "", "  ", "yesterday", "Wed, 14 Feb 2024 10:00:01", "Wed, 4 Feb 2024 10:00:01 GMT", "Wed, 32 Jan 2024 10:00:01 GMT", "Wed, 14 Fev 2024 10:00:01 GMT", "Wed, 14 Feb 2024 24:00:00 GMT", "2024-02-14T10:00:01Z"):
        assert conditional.http_date(text) is None, text


BOARDS = "uri string, etag string, last_modified timestamp, status string"
RESPONSES = "uri string, status int, etag string, last_modified string, body string, bucket string"
FEB = "Wed, 14 Feb 2024 10:00:00 GMT"


def scan(spark, place, boards, responses, buckets=None):
    n = conditional.store(spark.createDataFrame(boards, BOARDS), spark.createDataFrame(responses, RESPONSES), str(place), buckets)
    return conditional.fetches(spark, str(place), n)


def test_conditional_scan(spark, tmp_path):
    at, late = utc(2024, 2, 14, 10), utc(2024, 2, 14, 10, 0, 0, 900000)
    cases = {
        # uri: (etag, since), (status, etag, last modified, body), outcome
        "same-tag": (("a", None), (200, "a", None, "x"), ("NOT_MODIFIED", 304, None, None, None)),
        "other-tag-same-time": (("a", at), (200, "b", FEB, "x"), ("FETCHED", 200, "b", at, "x")),
        "blank-tag": ((" ", at), (200, "b", FEB, "x"), ("NOT_MODIFIED", 304, None, None, None)),
        "part-of-a-second": ((None, late), (200, None, FEB, "x"), ("NOT_MODIFIED", 304, None, None, None)),
        "older": ((None, utc(2024, 2, 14, 9, 59, 59)), (200, None, FEB, ""), ("FETCHED", 200, None, at, "")),
        "no-validators": ((None, None), (200, "a", "never", None), ("FETCHED", 200, "a", None, "")),
        "unasked-304": ((None, None), (304, None, None, "x"), ("NOT_MODIFIED", 304, None, None, None)),
        "gone": (("a", at), (404, "a", FEB, "x"), ("FAILED", 404, None, None, None)),
        "broken": ((None, None), (None, "a", FEB, "x"), ("FAILED", 0, None, None, None)),
        "ü": ((None, None), None, ("FAILED", 0, None, None, None)),
        "long": ((None, None), (200, None, None, "é" * 3_000_000), ("FETCHED", 200, None, None, "é" * 3_000_000)),
    }
    boards = [(uri, *b, "clash") for uri, (b, _, _) in cases.items()] + [("same-tag", "a", None, ""), (None, "a", at, "")]
    responses = [(uri, *r, "clash") for uri, (_, r, _) in cases.items() if r] + [("unasked", 200, "a", FEB, "x", ""), (None, 200, "a", FEB, "x", "")]
    for buckets in (None, 5):
        rows = scan(spark, tmp_path / f"b{buckets}", boards, responses, buckets)
        # The session's zone is UTC; the client's may be another.
        got = {r.uri: r for r in rows.select("*", F.unix_seconds("last_modified").alias("s")).collect()}
        assert len(got) == rows.count() == len(cases)
        for uri, (_, _, (outcome, status, etag, modified, body)) in cases.items():
            r = got[uri]
            assert (r.outcome, r.status, r.etag, r.s, r.body) == (outcome, status, etag, modified and int(modified.timestamp()), body), uri
            assert (r.error is not None) == (outcome == "FAILED")
    assert scan(spark, tmp_path / "empty", [], responses).count() == 0


def test_filters_reach_the_source(spark, tmp_path):
    boards = [(f"u{i}", None, None, "") for i in range(100)]
    rows = scan(spark, tmp_path / "p", boards, [(f"u{i}", 200, None, None, str(i), "") for i in range(100)], 8)
    assert rows.rdd.getNumPartitions() == 8
    wanted = {i for i in range(100) if conditional.bucket_of(f"u{i}", 8) in (2, 5)}
    for found, partitions, ids in ((rows.where("uri = 'u7'"), 1, {7}), (rows.where("bucket in (2, 5)"), 2, wanted), (rows.where("bucket = 2 and bucket = 5"), 0, set()), (rows.where("bucket in (2, 5) and outcome = 'FETCHED'"), 2, wanted), (rows.where("uri = 'none'"), 1, set())):
        assert found.rdd.getNumPartitions() == partitions
        assert {int(r.body) for r in found.collect()} == ids


def plain_quota(rows, cap):
    out, used, jobs = [], defaultdict(int), defaultdict(set)
    for who, job, event, at in sorted({r[:4] for r in rows if None not in r[:4]}, key=lambda r: (r[3], r[2], r[1])):
        day = (who, at.date())
        used[day] += 1
        if used[day] > cap:
            outcome = "LIMITED"
        elif job in jobs[who]:
            used[day] -= 1
            outcome = "CONFLICT"
        else:
            jobs[who].add(job)
            outcome = "CREATED"
        out.append((who, job, event, at, outcome, max(0, cap - used[day])))
    return sorted(out)


def test_quota(spark):
    for seed, cap in ((1, 3), (2, 1), (3, 10)):
        draw = random.Random(seed)
        rows = [(draw.choice([1, 1, draw.randint(2, 40)]), draw.randint(1, 60), draw.randint(0, 50) if draw.random() < 0.1 else i, START + timedelta(hours=i // 9), "clash", 0) for i in range(2500)]
        rows += rows[:50] + [(None, 1, 1, START, "", 0), (1, None, 1, START, "", 0), (1, 1, None, START, "", 0), (1, 1, 1, None, "", 0)]
        frame = spark.createDataFrame(rows, "who long, job long, id long, ts timestamp_ntz, day string, place int")
        found = quota.consume(frame, "who", "job", "id", "ts", cap)
        want = plain_quota(rows, cap)
        assert sorted(map(tuple, found.collect())) == want
        assert {r[4] for r in want} == {"CREATED", "CONFLICT", "LIMITED"}
    assert quota.consume(frame.limit(0), "who", "job", "id", "ts").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # what is folded is cut before the shuffle


def test_quantiles(spark):
    draw = random.Random(5)
    bounds = [-1, 0.5, 2, 8]
    rows = [(draw.choice(["a", "b", None]), START + timedelta(minutes=draw.randint(0, 600)), draw.choice([draw.uniform(-3, 12), 0.5, 8.0, None]), 1) for _ in range(800)]
    rows += [("nan", START, float("nan"), 1), ("none", START, None, 1), ("low", START, -5.0, 1), ("a", None, 1.0, 1)]
    frame = spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double, counts int")
    hour = 3600
    found = metrics.sliding_histogram(frame, ["series"], "ts", "v", bounds, 3 * hour, hour)
    got = {(r.series, r.window_end): (list(r.counts), r.h, r.top) for r in found.select("*", metrics.quantile(F.col("counts"), bounds, 0.5).alias("h"), metrics.quantile(F.col("counts"), bounds, 1.0).alias("top")).collect()}
    values = defaultdict(list)
    for series, ts, v, _ in rows:
        if ts is not None:
            end = math.ceil((ts - START).total_seconds() / hour)
            for i in range(3):
                values[series, int(utc(2024, 1, 1).timestamp() + (end + i) * hour) * 1_000_000].append(v)

    def plain(counts, q):
        rank = q * counts[-1]
        if not counts[-1]:
            return None
        low, before = 0.0, 0
        for bound, n in zip(bounds, counts):
            if n >= rank:
                return float(bound) if bound <= 0 and before == 0 and bound == bounds[0] else low + (bound - low) * (rank - before) / (n - before)
            low, before = bound, n
        return float(bounds[-1])

    assert set(got) == set(values)
    for key, vs in values.items():
        counts = [sum(v is not None and v <= b for v in vs) for b in bounds] + [sum(v is not None for v in vs)]
        assert got[key][0] == counts
        for have, q in ((got[key][1], 0.5), (got[key][2], 1.0)):
            assert have == plain(counts, q) or have == pytest.approx(plain(counts, q))
    halves = [metrics.histogram(frame.where(F.col("v") > 1), ["series"], "v", bounds), metrics.histogram(frame.where("not v > 1 or v is null"), ["series"], "v", bounds)]
    assert sorted(map(repr, metrics.merge(halves[0].union(halves[1]), ["series"], 4).collect())) == sorted(map(repr, metrics.histogram(frame, ["series"], "v", bounds).collect()))
    for wrong in (lambda: metrics.quantile(F.col("counts"), bounds, 0), lambda: metrics.histogram(frame, [], "v", [2, 1]), lambda: metrics.histogram(frame, [], "v", []), lambda: metrics.sliding_histogram(frame, [], "ts", "v", bounds, 5, 3)):
        with pytest.raises(ValueError):
            wrong()


def plain_rate(samples, start, end):
    """``samples`` of (seconds, value) in order."""
    rise = samples[-1][1] - samples[0][1] + sum(a[1] for a, b in zip(samples, samples[1:]) if b[1] < a[1])
    sampled = samples[-1][0] - samples[0][0]
    gap = sampled / (len(samples) - 1)
    head, tail = samples[0][0] - start, end - samples[-1][0]
    head, tail = (gap / 2 if x >= 1.1 * gap else x for x in (head, tail))
    if rise > 0 and samples[0][1] >= 0:
        head = min(head, sampled * samples[0][1] / rise)
    return rise, rise * (sampled + head + tail) / sampled / (end - start)


def test_counter_rates(spark):
    draw = random.Random(9)
    rows, value = [], 0.0
    for i in range(1500):
        value = 0.0 if draw.random() < 0.05 else value + draw.choice([0, 1, 5])
        rows.append((draw.choice(["a", "a", "b", None]), START + timedelta(seconds=draw.choice([i * 7, i // 20 * 140])), value, "clash", 1))
    rows += rows[:20] + [("alone", START, 1.0, "", 1), ("a", None, 1.0, "", 1), ("a", START, None, "", 1), ("flat", START, 3.0, "", 1), ("flat", START + timedelta(seconds=60), 3.0, "", 1), ("edge", START + timedelta(seconds=60), 1.0, "", 1), ("edge", START + timedelta(seconds=120), 4.0, "", 1)]
    frame = spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double, step string, n int")
    found = metrics.counter_rates(frame, ["series"], "ts", "v", 300, 60)
    at = defaultdict(dict)
    for series, ts, v, *_ in rows:
        if ts is not None and v is not None:
            second = int((ts - START).total_seconds())
            at[series][second] = max(v, at[series].get(second, v))
    want = {}
    for series, points in at.items():
        for end in range(0, 12_000, 60):
            inside = [(t, points[t]) for t in sorted(points) if end - 300 < t <= end]
            if len(inside) > 1:
                want[series, end] = (len(inside), *plain_rate(inside, end - 300, end))
    origin = int(utc(2024, 1, 1).timestamp())
    got = {(r.series, r.window_end // 1_000_000 - origin): (r.n, r.increase, r.rate) for r in found.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert ("alone", 60) not in got and got["flat", 60][2] == 0
    assert metrics.counter_rates(frame.limit(0), ["series"], "ts", "v", 300, 60).count() == 0


OUTCOMES, BOUNDS = ["ok", "failed"], [1.0, 5.0]


def outcomes():
    draw = random.Random(3)
    return [(draw.choice(["ok", "ok", "failed", "odd", None]), draw.choice([0.5, 1.0, 3.0, 9.0, None])) for _ in range(400)]


def plain_measures(rows):
    out = []
    for name in [*OUTCOMES, "other"]:
        mine = [v for o, v in rows if (o if o in OUTCOMES else "other") == name]
        values = [v for v in mine if v is not None]
        out.append((name, len(mine), sum(values), [sum(v <= b for v in values) for b in BOUNDS] + [len(values)]))
    return out


def test_measures_pass_by_in_a_batch(spark, tmp_path):
    for rows in (outcomes(), []):
        frame, seen = observed.observe(spark.createDataFrame(rows, "o string, v double"), f"batch-{len(rows)}", "o", OUTCOMES, "v", BOUNDS)
        frame.write.parquet(str(tmp_path / str(len(rows))))
        assert [tuple(r) for r in observed.told(spark, seen, OUTCOMES, BOUNDS).collect()] == plain_measures(rows)


def test_measures_pass_by_in_a_stream(spark, tmp_path):
    rows = outcomes()
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], "o string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("o string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counters = observed.Counters("passing", OUTCOMES, BOUNDS)
    spark.streams.addListener(counters)
    try:
        frame, _ = observed.observe(stream, "passing", "o", OUTCOMES, "v", BOUNDS)
        frame.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        end = time.monotonic() + 20  # progress is told a little later
        while counters.totals() != plain_measures(rows) and time.monotonic() < end:
            time.sleep(0.1)
        assert counters.totals() == plain_measures(rows)
    finally:
        spark.streams.removeListener(counters)


def test_a_batch_told_again_counts_once():
    counters = observed.Counters("x", ["a"], [1])
    for stream, batch, n in (("s", 0, 2), ("s", 1, 3), ("s", 1, 3), ("s", 0, 2), ("s", 4, 1), ("t", 0, 10)):
        counters.add(stream, batch, {"0_n": n})
    assert counters.totals()[0] == ("a", 16, 0.0, [0, 0])


def test_companies_and_boards(spark):
    companies = spark.createDataFrame([("a", "A", "a.example", None), ("b", "B", None, "b/jobs")], "slug string, name string, domain string, url string")
    incoming = spark.createDataFrame([("a", 2, "A2", None, "a/2"), ("a", 1, "A1", "old.example", "a/1"), ("c", 1, "C", None, None), ("c", 2, None, "c.example", None), (None, 1, "N", "n", "n"), ("a", 3, "A3", None, None), ("a", 3, "A3", None, None)], "slug string, n int, name string, domain string, url string")
    found = ingest.upsert_companies(companies, incoming, "slug", "name", ["domain", "url"], ["n"])
    assert sorted(map(tuple, found.collect())) == [("a", "A3", "old.example", "a/2", False), ("b", "B", None, "b/jobs", False), ("c", "C", "c.example", None, True)]
    assert sorted(map(tuple, ingest.upsert_companies(companies, incoming.limit(0), "slug", "name", ["domain", "url"], ["n"]).collect())) == [("a", "A", "a.example", None, False), ("b", "B", None, "b/jobs", False)]
    boards = spark.createDataFrame([("x", "1", 60, False), ("x", "2", 60, False), ("y", "1", None, True)], "source string, token string, seconds int, enabled boolean")
    again = spark.createDataFrame([("x", "1", 1, 900), ("y", "1", 1, 900), ("y", "2", 2, 300), ("y", "2", 1, None), (None, "1", 1, 1), ("x", None, 1, 1)], "source string, token string, n int, seconds int")
    found = ingest.register_boards(boards, again, ["source", "token"], ["seconds"], ["n"])
    assert sorted(map(tuple, found.collect())) == [("x", "1", 60, True, False), ("x", "2", 60, False, False), ("y", "1", None, True, False), ("y", "2", None, True, True)]
