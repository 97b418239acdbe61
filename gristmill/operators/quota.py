"""Daily quotas of requests, with a refund where the request was made before.

An attempt takes one of the day's units first. Beyond the cap it is refused, and what it took is lost. Within it, a job that
the seeker has asked for on any day is a conflict, and its unit is given back. So a day's units go to its first jobs that
are new, and whatever follows the last unit is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A fixed value: requests that a seeker may make a day.
CAP = 10


def _grant(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """The rows that create a request, of rows ordered by seeker, day and place. It holds one seeker's jobs."""
    who = today = None
    used, jobs = 0, set()
    for batch in batches:
        keep = []
        for i, (seeker, day, job) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seeker", "day", "job")))):
            if seeker != who:
                who, today, jobs = seeker, None, set()
            if day != today:
                today, used = day, 0
            if used < cap and job not in jobs:
                used += 1
                jobs.add(job)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def consume(attempts: DataFrame, seeker: str, job: str, event: str, at: str, cap: int = CAP) -> DataFrame:
    """``(seeker, job, event_id, at, outcome, remaining)`` for each attempt: CREATED, CONFLICT (asked for before; refunded) or
    LIMITED, and the units left after it.

    Attempts are taken in order of time, event and job; rows equal in all four count once, rows with a null in any of them
    are left out.

    Only a day's first attempt for each job can create a request, and at most ``cap`` times the days of the table were
    created before, so a seeker's first ``cap`` x days jobs of a day hold all that the day creates. Tasks cut to these before
    the shuffle. What is folded in order is thus bounded by the span of days, not by a seeker's attempts; verdicts come
    back by seeker and day, at most ``cap`` places each, in a join that is split at a hot seeker.
    """
    rows = attempts.select(F.col(seeker).alias("seeker"), F.col(job).alias("job"), F.col(event).alias("event_id"), F.col(at).alias("at")).dropna()
    rows = rows.withColumn("day", F.to_date("at"))
    span = rows.agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("days")).first()["days"] or 1
    rows = rows.distinct().withColumn("place", F.struct("at", "event_id", "job"))
    firsts = rows.groupBy("seeker", "day", "job").agg(F.min("place").alias("place"))
    n = F.row_number().over(Window.partitionBy("seeker", "day").orderBy("place"))
    firsts = firsts.withColumn("n", n).where(F.col("n") <= cap * span).drop("n")
    ordered = firsts.repartition("seeker").sortWithinPartitions("seeker", "place")
    created = ordered.mapInArrow(lambda batches: _grant(batches, cap), ordered.schema)
    created = created.groupBy("seeker", "day").agg(F.array_sort(F.collect_list("place")).alias("places"))
    judged = rows.join(created, ["seeker", "day"], "left")
    places = F.coalesce("places", F.array().cast(created.schema["places"].dataType))
    over = (F.size(places) >= cap) & (F.col("place") > F.try_element_at(places, F.lit(-1)))
    outcome = F.when(F.array_contains(places, F.col("place")), "CREATED").when(F.coalesce(over, F.lit(False)), "LIMITED").otherwise("CONFLICT")
    return judged.select("seeker", "job", "event_id", "at", outcome.alias("outcome"), (F.lit(cap) - F.size(F.filter(places, lambda p: p <= F.col("place")))).cast("int").alias("remaining"))
