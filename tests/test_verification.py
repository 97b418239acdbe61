"""Verification codes and leases against a plain fold, with the times and tries of the rule."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gristmill.operators import verification

START = datetime(2024, 1, 1)
SCHEMA = "who long, at_company string, id long, ts timestamp_ntz, begins boolean, ok boolean, start string, place int"


def brute(rows):
    """Outcomes by row, and (status, end of lease) by key."""
    out, keys = [], {}
    whole = {(*r[:5], bool(r[5]) and not r[4]) for r in rows if None not in r[:5]}
    for who, company, event, ts, begins, ok in sorted(whole, key=lambda r: (r[3], r[2], not r[4], r[5])):
        status, good, bad, lease = keys.get((who, company), ("NONE", None, 0, None))
        if begins:
            outcome, status, good, bad, lease = "started", "PENDING", ts + timedelta(minutes=15), 0, None
        elif status == "NONE":
            outcome = "none"
        elif status == "REVOKED":
            outcome = "revoked"
        elif good is None or good < ts:
            outcome = "expired"
        elif ok:
            outcome, status, good, bad, lease = "verified", "VERIFIED", None, 0, ts + timedelta(days=90)
        else:
            bad += 1
            outcome, status = ("locked", "REVOKED") if bad >= 5 else ("wrong", status)
        out.append((who, company, event, ts, outcome, lease if outcome == "verified" else None))
        if status != "NONE":
            keys[who, company] = (status, good, bad, lease)
    return sorted(out, key=repr), {k: (v[0], v[3]) for k, v in keys.items()}


def attempts(seed, n=1500):
    """One key with most of the tries, over midnights; ties in time and id, repeated rows, nulls, the code's last moment."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        who = draw.choice([1, 1, draw.randint(2, 30)])
        ts = START + timedelta(minutes=i if draw.random() < 0.7 else 5 * (i // 5))
        rows.append((who, draw.choice(["x", "x", "y"]) if who > 1 else "x", i // 2 if draw.random() < 0.1 else i, ts, draw.random() < 0.12, draw.choice([True, False, False, False, False, False, None]), "clash", 1))
    edge = [(50, "x", 1, START, True, None), (50, "x", 2, START + timedelta(minutes=15), False, True), (51, "x", 3, START, True, True), (51, "x", 4, START + timedelta(minutes=15, microseconds=1), False, True)]
    edge += [(52, "x", 5, START, True, None), (52, "x", 6, START + timedelta(days=9), False, False), (52, "x", 7, START + timedelta(days=9), True, None), (52, "x", 8, START + timedelta(days=9), False, True)]
    edge += [(None, "x", 9, START, True, True), (60, None, 9, START, True, True), (60, "x", None, START, True, True), (60, "x", 9, None, True, True), (60, "x", 9, START, None, True)]
    return rows + rows[:30] + [(*r, "", 0) for r in edge]


def test_outcomes_and_leases(spark):
    for seed in (1, 2):
        rows = attempts(seed)
        frame = spark.createDataFrame(rows, SCHEMA)
        found = verification.outcomes(frame, "who", "at_company", "id", "ts", "begins", "ok")
        want, keys = brute(rows)
        assert sorted(map(tuple, found.collect()), key=repr) == want
        assert {r[4] for r in want} == {"started", "none", "revoked", "expired", "verified", "locked", "wrong"}
        for day in (0, 300):
            now = START + timedelta(days=day)
            got = {(r.person, r.company): (r.status, r.expires_at) for r in verification.leases(found, F.lit(now).cast("timestamp_ntz")).collect()}
            assert got == {k: ("EXPIRED" if status == "VERIFIED" and lease < now else status, lease) for k, (status, lease) in keys.items()}
    assert verification.outcomes(frame.limit(0), "who", "at_company", "id", "ts", "begins", "ok").count() == 0


def test_wrong_tries_are_cut_before_they_are_shuffled(spark):
    frame = spark.createDataFrame(attempts(3, 50), SCHEMA)
    plan = verification.outcomes(frame, "who", "at_company", "id", "ts", "begins", "ok")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Python" not in plan
