"""Verification of work addresses: one-time codes with few tries, and leases that run out.

A person starts a verification at a company and is sent a code, which is good for a short while. A start takes the place of
whatever was before: tries count anew. The right code in time gives a lease; the fifth wrong one locks the verification
until the next start. An outcome depends only on the start before it, and within one start's tries on the first right one
and the fifth wrong one, so there is no fold over a person's history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How long a code is good, how many wrong ones lock, how long a lease runs.
CODE = "15 minutes"
TRIES = 5
LEASE = "90 days"

_KEY = ["person", "company"]


def _starts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the place of the last start up to each row.

    Days are joined by a row per key and day, with the last start of earlier days; only a key's rows of one day are
    ordered together.
    """
    mine = F.when(F.col("is_start"), F.col("place"))
    earlier = Window.partitionBy(*_KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*_KEY, "day").agg(F.max(mine).alias("last"))
    days = days.select(*_KEY, "day", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    today = Window.partitionBy(*_KEY, "day").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("today", F.last(mine, ignorenulls=True).over(today)).join(days, [*_KEY, "day"])
    return found.withColumn("start", F.coalesce("today", "carried")).drop("today", "carried")


def outcomes(events: DataFrame, person: str, company: str, event: str, at: str, is_start: str, right: str, code: str = CODE) -> DataFrame:
    """``(person, company, event_id, at, outcome, expires_at)`` for each event: a start or, with ``is_start`` false, a try.

    The outcome of a start is ``started``. Of a try: ``none`` without a start before; ``revoked`` once five wrong ones locked
    the verification; ``expired`` once the code was used or its time is over (its last moment is still good);
    ``verified``, with the end of the lease; ``wrong``; and ``locked`` for the fifth wrong one. Tries beyond the
    code's time don't count. Events are taken in order of time, id, start before try, wrong before right; rows equal
    in all columns count once. Rows with a null in any of these columns but ``right`` are left out; a null ``right`` is wrong.

    The verdict on a start's tries is a row per start. Its fifth wrong try comes from a rank cut to five, which each task
    applies before the shuffle, and its first right one from a minimum, so a start with a third of all tries fills no task;
    the join that brings verdicts back is split at such a start.
    """
    rows = events.select(F.col(person).alias("person"), F.col(company).alias("company"), F.col(event).alias("event_id"), F.col(at).alias("at"), F.col(is_start).alias("is_start"), F.coalesce(F.col(right), F.lit(False)).alias("right"))
    rows = rows.dropna().withColumn("right", F.col("right") & ~F.col("is_start")).distinct()
    rows = rows.withColumn("place", F.struct("at", "event_id", (~F.col("is_start")).alias("is_try"), "right")).withColumn("day", F.to_date("at"))
    rows = _starts(rows)
    keys = [*_KEY, "start"]
    tries = rows.where(~F.col("is_start") & F.col("start").isNotNull()).withColumn("in_time", F.col("at") <= F.col("start.at") + F.expr(f"interval {code}"))
    live = tries.where("in_time")
    wrong = live.where("not right").select(*keys, "place").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("n") <= TRIES)
    verdicts = live.where("right").select(*keys, "place", F.lit(0).alias("n")).union(wrong.where(F.col("n") == TRIES)).groupBy(*keys)
    verdicts = verdicts.agg(F.min(F.when(F.col("n") == 0, F.col("place"))).alias("used"), F.min(F.when(F.col("n") == TRIES, F.col("place"))).alias("locked"))
    # Whichever comes first ends the matter; the other then never happens.
    verdicts = verdicts.select(*keys, F.when(F.col("locked").isNull() | (F.col("used") < F.col("locked")), F.col("used")).alias("used"), F.when(F.col("used").isNull() | (F.col("locked") < F.col("used")), F.col("locked")).alias("locked"))
    judged = tries.join(verdicts, keys, "left")
    outcome = (
        F.when(F.col("locked") < F.col("place"), "revoked")
        .when((F.col("used") < F.col("place")) | ~F.col("in_time"), "expired")
        .when(F.col("right"), "verified")
        .when(F.col("locked") == F.col("place"), "locked")
        .otherwise("wrong")
    )
    judged = judged.select(*_KEY, "event_id", "at", outcome.alias("outcome"))
    rest = rows.where("is_start or start is null").select(*_KEY, "event_id", "at", F.when(F.col("is_start"), "started").otherwise("none").alias("outcome"))
    return judged.union(rest).withColumn("expires_at", F.when(F.col("outcome") == "verified", F.col("at") + F.expr(f"interval {LEASE}")))


def leases(outcomes: DataFrame, now) -> DataFrame:
    """``(person, company, status, expires_at)`` at ``now`` of each verification that was started: PENDING since the last start,
    REVOKED, VERIFIED until its lease ends, or EXPIRED. Only what happened since the last start counts; no history is sorted."""
    told = outcomes.where("outcome in ('started', 'verified', 'locked')").groupBy(*_KEY)
    status = F.when(F.col("last.outcome") == "started", "PENDING").when(F.col("last.outcome") == "locked", "REVOKED").when(F.col("last.expires_at") < now, "EXPIRED").otherwise("VERIFIED")
    # At one time and id a start comes before a try.
    last = F.max(F.struct("at", "event_id", (F.col("outcome") != "started").alias("is_try"), "outcome", "expires_at"))
    return told.agg(last.alias("last")).select(*_KEY, status.alias("status"), "last.expires_at")
