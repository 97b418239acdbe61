"""Due queues, token buckets and smoothed rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def claim_due(queue: DataFrame, now: Column, limit: int, due: str = "due_at", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The earliest due rows, and the queue without them."""
    claimed = queue.where(F.col(due) <= now).orderBy(due, key).limit(limit)
    return claimed, queue.join(claimed.select(key), key, "left_anti")


def bucket_steps(times: list[float], rate: float, capacity: float) -> list[tuple[bool, float, int]]:
    """(allowed, tokens left, milliseconds to wait) of one bucket: full at first; a clock that goes back adds nothing."""
    tokens, last, out = capacity, None, []
    for now in times:
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, now - last) * rate)
        last = now if last is None else max(last, now)
        allowed = tokens >= 1
        tokens -= allowed
        out.append((allowed, tokens, 0 if allowed else int(-(-(1 - tokens) / rate * 1000 // 1))))
    return out


def token_bucket(requests: DataFrame, key: str, seconds: str, order: list[str], rate: float = 2.0, capacity: float = 10.0) -> DataFrame:
    """``requests`` with ``allowed``, ``tokens`` and ``wait_ms``. The running state isn't a window frame, so each key's
    requests are folded in order."""
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType()), T.StructField("wait_ms", T.LongType())])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        steps = bucket_steps(group[seconds].tolist(), rate, capacity)
        return group.assign(allowed=[s[0] for s in steps], tokens=[s[1] for s in steps], wait_ms=[s[2] for s in steps])

    return requests.groupBy(key).applyInPandas(fold, schema)


def smoothed_rate(visits: DataFrame, key: str, order: str, seen: str, days: str, prior: float = 1.0, alpha: float = 0.3) -> DataFrame:
    """(key, rate): the moving average over a key's visits in order; a visit after no time changes nothing."""
    steps = F.array_sort(F.collect_list(F.struct(order, seen, days)))
    step = lambda rate, v: F.when(v[days] <= 0, rate).otherwise(alpha * (v[seen] / v[days]) + (1 - alpha) * rate)
    return visits.groupBy(key).agg(F.aggregate(steps, F.lit(prior), step).alias("rate"))
