"""The referral's finite-state machine over audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which state may follow which; the others end a request.
NEXT = {"REQUESTED": ["ACCEPTED", "DECLINED", "EXPIRED"], "ACCEPTED": ["SUBMITTED", "EXPIRED", "CLOSED"], "SUBMITTED": ["CLOSED"]}
TERMINAL = ["DECLINED", "EXPIRED", "CLOSED"]


def legal(before: Column, after: Column) -> Column:
    """Requests begin as REQUESTED; from there the table holds."""
    out = F.when(before.isNull(), after == "REQUESTED")
    for state, following in NEXT.items():
        out = out.when(before == state, after.isin(following))
    return out.otherwise(F.lit(False))


def validate(audit: DataFrame, request: str, order: list[str], state: str) -> DataFrame:
    """``audit`` with ``from_state`` (the row before) and ``legal``."""
    before = F.lag(state).over(Window.partitionBy(request).orderBy(*order))
    return audit.withColumn("from_state", before).withColumn("legal", legal(F.col("from_state"), F.col(state)))


def timestamps(audit: DataFrame, request: str, state: str, at: str) -> DataFrame:
    """When each request was first accepted, submitted and brought to an end."""
    first = lambda states: F.min(F.when(F.col(state).isin(states), F.col(at)))
    return audit.groupBy(request).agg(first(["ACCEPTED"]).alias("accepted_at"), first(["SUBMITTED"]).alias("submitted_at"), first(TERMINAL).alias("closed_at"))


def expire(requests: DataFrame, state: str, deadline: str, now: Column, limit: int | None = None) -> DataFrame:
    """Requests past their deadline that haven't ended, earliest first."""
    due = requests.where(F.col(state).isin("REQUESTED", "ACCEPTED") & (F.col(deadline) < now)).orderBy(deadline, *[c for c in requests.columns if c.endswith("id")])
    return due if limit is None else due.limit(limit)


#: How long a request may stay unanswered or unfinished; a fixed value.
EXPIRY = "7 days"
OPEN = ["REQUESTED", "ACCEPTED"]


def _longest(state: str = "REQUESTED") -> int:
    return 1 + max((_longest(x) for x in NEXT.get(state, [])), default=0)


def trace(audit: DataFrame, request: str, event: str, at: str, state: str, now: Column | None = None, expiry: str = EXPIRY) -> DataFrame:
    """``(request_id, event_id, at, from_state, to_state, legal)``: each event against the state its request is in, and a
    row without an event for each request that expired.

    A request begins with its first REQUESTED and expires ``expiry`` after it if it is still open then: what comes later
    meets EXPIRED. With ``now``, requests whose deadline is before it expire without a later event. Illegal events change
    nothing. Events are taken in order of time and id; a redelivered row (equal in all four columns) counts once; of rows
    with equal time and id the lesser state is first. Rows with a null request, event, time or state are left out.

    A request passes at most as many states as the longest way through ``NEXT``, so there are that many rounds of a
    minimum and a join by request. Minima combine before the shuffle and the other side of the join has a row per
    request, so a request with a third of all events is split by the skew handling of joins, never one task's window.
    """
    rows = audited(audit, request, event, at, state)
    return met(rows, ways(rows, now, expiry))


def audited(audit: DataFrame, request: str, event: str, at: str, state: str) -> DataFrame:
    """``(request_id, event_id, at, to_state)`` without nulls and redelivered rows."""
    return audit.select(F.col(request).alias("request_id"), F.col(event).alias("event_id"), F.col(at).alias("at"), F.col(state).alias("to_state")).dropna().distinct()


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.struct("at", "event_id", "to_state"))


def ways(rows: DataFrame, now: Column | None = None, expiry: str = EXPIRY, before: DataFrame | None = None) -> DataFrame:
    """Of ``audited`` rows ``(request_id, way, ends, deadline, expired_at)``: each request's legal events in order, the state behind
    the last, null if it hasn't begun, and when it expired.

    ``before(request_id, state, deadline)`` is where requests that began earlier are. Their way begins with that state, without a
    time and an event; they are there even if no event of theirs is.
    """
    rows = _placed(rows)
    known = rows.groupBy("request_id").agg(F.min(F.when(F.col("to_state") == "REQUESTED", F.col("place"))).alias("last"), F.max("at").alias("latest"))
    until = F.col("last.at") + F.expr(f"interval {expiry}")
    if before is not None:
        fields = {f.name: f.dataType for f in known.schema["last"].dataType}
        known = known.join(before.select("request_id", "state", F.col("deadline").alias("until")), "request_id", "full")
        prior = F.struct(*[F.lit(None).cast(fields[c]).alias(c) for c in ("at", "event_id")], F.col("state").alias("to_state"))
        known = known.select("request_id", "latest", F.when(F.col("state").isNotNull(), prior).otherwise(F.col("last")).alias("last"), "until")
        until = F.coalesce("until", until)
    known = known.select("request_id", "latest", "last", until.alias("deadline"), F.when(F.col("last").isNotNull(), F.array("last")).otherwise(F.array().cast(f"array<{known.schema['last'].dataType.simpleString()}>")).alias("way"))
    for _ in range(_longest() - 1):
        follows = rows.join(known.where("last is not null").select("request_id", "last", "deadline"), "request_id").where((F.col("place") > F.col("last")) & legal(F.col("last.to_state"), F.col("to_state")))
        follows = follows.where(~F.col("last.to_state").isin(OPEN) | (F.col("at") <= F.col("deadline"))).groupBy("request_id").agg(F.min("place").alias("next"))
        known = known.join(follows, "request_id", "left").select("request_id", "latest", "deadline", F.col("next").alias("last"), F.when(F.col("next").isNotNull(), F.array_append("way", F.col("next"))).otherwise(F.col("way")).alias("way"))
    ends = F.element_at("way", -1)["to_state"]
    due = F.col("latest") > F.col("deadline") if now is None else (F.col("latest") > F.col("deadline")) | (F.col("deadline") < now)
    known = known.select("request_id", "way", F.when(F.size("way") > 0, ends).alias("ends"), "deadline", due.alias("due"))
    return known.select("request_id", "way", "ends", "deadline", F.when(F.col("ends").isin(OPEN) & F.col("due"), F.col("deadline")).alias("expired_at"))


def met(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What ``trace`` gives, of ``audited`` rows and their ``ways``."""
    rows = _placed(rows)
    before = F.filter("way", lambda x: x < F.col("place"))
    from_state = F.when(F.col("at") > F.col("expired_at"), F.lit("EXPIRED")).when(F.size(before) > 0, F.element_at(before, -1)["to_state"])
    met = rows.join(known.select("request_id", "way", "expired_at"), "request_id")
    met = met.select("request_id", "event_id", "at", from_state.alias("from_state"), "to_state", F.array_contains("way", F.col("place")).alias("legal"))
    timed = known.where("expired_at is not null").select("request_id", F.lit(None).cast(rows.schema["event_id"].dataType).alias("event_id"), F.col("expired_at").alias("at"), F.col("ends").alias("from_state"), F.lit("EXPIRED").alias("to_state"), F.lit(True).alias("legal"))
    return met.unionByName(timed)
