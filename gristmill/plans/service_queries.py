"""Queries of conditional scans, quotas with refunds, and the measures of a dashboard."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ingest, metrics, observed, quota
from ..operators.staging import folder
from ..sources import conditional
from .base import query, table

_HOUR = 3600
_K = "try_cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as bigint)"


def _k():
    return F.regexp_extract("props", '"k": *([0-9]+)', 1).try_cast("long")


_TAG = "'\"' || md5(h) || '\"'"
_SAME = "case when page_id % 2 = 0 then page_id % 3 <> 2 else page_id % 3 <> 0 and page_id % 5 <> 0 and page_id % 28 + 1 <= 14 end"


@query(f"""with p as (select page_id, coalesce(html, '') as h, case when page_id % 11 = 0 then 0 when page_id % 7 = 0 then 404 when page_id % 7 = 1 then 503 when {_SAME} then 304 else 200 end as status from pages)
select page_id, case when status = 0 or status >= 400 then 'FAILED' when status = 304 then 'NOT_MODIFIED' else 'FETCHED' end as outcome, status, case when status = 200 then sha256(h) end as body_sha256, case when status = 200 and page_id % 3 <> 2 then {_TAG} end as etag,
  case when status = 200 and page_id % 5 <> 0 then epoch_us(timestamp '2024-02-01 10:00:00' + to_days((page_id % 28)::integer)) end as modified_us, case when status = 0 then 'no response' when status >= 400 then 'board returned HTTP ' || status end as error from p""")
def conditional_scan(spark, sf_dir):
    """Pages as responses that are stored with tags and times, and fetched with what a crawl knew of them."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("body"))
    id_ = F.col("page_id")
    uri, tag = F.concat(F.lit("https://boards.example.com/"), id_), F.concat(F.lit('"'), F.md5("body"), F.lit('"'))
    modified = F.when(id_ % 5 == 0, "yesterday").otherwise(F.concat(F.lit("Mon, "), F.lpad((id_ % 28 + 1).cast("string"), 2, "0"), F.lit(" Feb 2024 10:00:00 GMT")))
    status = F.when(id_ % 7 == 0, 404).when(id_ % 7 == 1, 503).otherwise(200)
    responses = pages.where(id_ % 11 != 0).select(uri.alias("uri"), status.alias("status"), F.when(id_ % 3 != 2, tag).alias("etag"), modified.alias("last_modified"), "body")
    known = F.when(id_ % 2 == 0, tag).when(id_ % 4 == 1, "")
    boards = pages.select(uri.alias("uri"), known.alias("etag"), F.when(id_ % 3 != 0, F.lit("2024-02-15 00:00:00").cast("timestamp")).alias("last_modified"))
    place = f"{folder(spark)}/fetches-{uuid.uuid4().hex}"
    rows = conditional.fetches(spark, place, conditional.store(boards, responses, place))
    return rows.select(F.substring_index("uri", "/", -1).cast("long").alias("page_id"), "outcome", "status", F.sha2("body", 256).alias("body_sha256"), "etag", F.unix_micros("last_modified").alias("modified_us"), "error")


#: Few units, as a client of the tables has few clicks a day.
_CAP = 3


@query(f"""with recursive r as (select distinct client_id as seeker, {_K} + 100 * month(ts) as job, click_id as event_id, ts as t from clicks where client_id is not null and ts is not null and click_id is not null and {_K} is not null),
e as materialized (select *, t::date as day, row_number() over (partition by seeker order by t, event_id, job) as n from r),
f as (
  select seeker, 0::bigint as n, null::bigint as job, null::bigint as event_id, null::timestamp as t, null::varchar as outcome, null::date as day, 0 as used, []::bigint[] as jobs from e where n = 1
  union all
  select seeker, n, job, event_id, t, outcome, day, case when outcome = 'CONFLICT' then took - 1 else took end, case when outcome = 'CREATED' then list_append(jobs, job) else jobs end
  from (select *, case when took > {_CAP} then 'LIMITED' when list_contains(jobs, job) then 'CONFLICT' else 'CREATED' end as outcome
    from (select e.*, f.jobs, case when e.day = f.day then f.used else 0 end + 1 as took from f join e on e.seeker = f.seeker and e.n = f.n + 1))
)
select seeker, job, event_id, epoch_us(t) as at_us, outcome, greatest(0, {_CAP} - used) as remaining from f where n > 0""")
def quota_refund(spark, sf_dir):
    """Clicks as requests for jobs, each job anew every month."""
    rows = table(spark, sf_dir, "clicks").select("client_id", (_k() + 100 * F.month("ts")).alias("job"), "click_id", "ts")
    rows = quota.consume(rows, "client_id", "job", "click_id", "ts", _CAP)
    return rows.select("seeker", "job", "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "outcome", "remaining")


_BOUNDS = [5, 10, 25, 50, 100, 250, 1000]
_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _steps_sql(hours: int, n: int, rows: str) -> str:
    """``rows`` in each of their ``n`` windows, one every ``hours`` hours."""
    slide = hours * _HOUR * 1_000_000
    return f"(select *, t + (({slide} - t % {slide}) % {slide}) + unnest(range(0, {n})) * {slide} as window_end from {rows})"


def _quantile_sql(q: float) -> str:
    edges = [0, *_BOUNDS]
    parts = [f"when {q} * n <= c{i} then {low} + ({high} - {low}) * ({q} * n - {f'c{i - 1}' if i else 0}) / (c{i} - {f'c{i - 1}' if i else 0})" for i, (low, high) in enumerate(zip(edges, edges[1:]))]
    return f"case when n = 0 then null {' '.join(parts)} else {_BOUNDS[-1]} end"


@query(f"""with w as {_steps_sql(6, 4, "(select kind, value, epoch_us(ts) as t from clicks where ts is not null)")},
h as (select kind, window_end, count(value) as n, {", ".join(f"count(*) filter (value <= {b}) as c{i}" for i, b in enumerate(_BOUNDS))} from w group by 1, 2)
select kind, window_end::bigint as window_end, n, {", ".join(f"round({_quantile_sql(q)}, 6)::double as {name}" for name, q in _QUANTILES.items())} from h""")
def histogram_quantiles(spark, sf_dir):
    """Values of each kind of click in the day before every sixth hour."""
    rows = metrics.sliding_histogram(table(spark, sf_dir, "clicks"), ["kind"], "ts", "value", _BOUNDS, 24 * _HOUR, 6 * _HOUR)
    return rows.select("kind", "window_end", F.get("counts", F.lit(len(_BOUNDS))).alias("n"), *[F.round(metrics.quantile(F.col("counts"), _BOUNDS, q), 6).alias(name) for name, q in _QUANTILES.items()])


@query(f"""with s as (select kind, epoch_us(ts) as t, max({_K})::double as v from clicks where ts is not null and {_K} is not null group by 1, 2),
l as (select *, lag(v) over (partition by kind, window_end order by t) as p from {_steps_sql(1, 6, "s")}),
g as (select kind, window_end, count(*) as n, min(t) as t0, max(t) as t1, arg_min(v, t) as v0, arg_max(v, t) - arg_min(v, t) + sum(case when v < p then p else 0 end) as rise from l group by 1, 2),
d as (select *, (t1 - t0) / 1e6 as d, (t1 - t0) / 1e6 / (n - 1) as gap, (t0 - window_end) / 1e6 + {6 * _HOUR} as a, (window_end - t1) / 1e6 as b from g where n >= 2),
x as (select *, case when a >= 1.1 * gap then gap / 2 else a end as head, case when b >= 1.1 * gap then gap / 2 else b end as tail from d)
select kind, window_end::bigint as window_end, n, rise as increase, round(rise * ((d + tail + case when rise > 0 and v0 >= 0 then least(head, d * v0 / rise) else head end) / d) / {6 * _HOUR}, 9)::double as rate from x""")
def counter_rates(spark, sf_dir):
    """A number in each click's properties as a counter of its kind, which falls often, over six hours at every hour."""
    rows = table(spark, sf_dir, "clicks").select("kind", "ts", _k().alias("k"))
    rows = metrics.counter_rates(rows, ["kind"], "ts", "k", 6 * _HOUR, _HOUR)
    return rows.withColumn("rate", F.round("rate", 9))


_OUTCOMES = ["view", "click", "purchase"]


@query(f"""with h as (select case when kind in ('view', 'click', 'purchase') then kind else 'other' end as outcome, count(*) as events, count(value) as n, sum(value) as total, {", ".join(f"count(*) filter (value <= {b}) as c{i}" for i, b in enumerate(_BOUNDS))} from clicks group by 1)
select outcome, events, round(total, 2) as total, {", ".join(f"round({_quantile_sql(q)}, 6)::double as {name}" for name, q in _QUANTILES.items())} from h""")
def observed_outcomes(spark, sf_dir):
    """Counters and quantiles of clicks by kind, taken while the clicks are written elsewhere."""
    rows, seen = observed.observe(table(spark, sf_dir, "clicks"), f"clicks-{uuid.uuid4().hex}", "kind", _OUTCOMES, "value", _BOUNDS)
    rows.write.parquet(f"{folder(spark)}/observed-{uuid.uuid4().hex}")
    found = observed.told(spark, seen, _OUTCOMES, _BOUNDS)
    return found.select("outcome", F.col("n").alias("events"), F.round("total", 2).alias("total"), *[F.round(metrics.quantile(F.col("counts"), _BOUNDS, q), 6).alias(name) for name, q in _QUANTILES.items()])


_KNOWN = "(select client_id, arg_max(segment, (updated_at, source)) as segment, arg_max(city, (updated_at, source)) as city from clients where client_id % 3 <> 0 group by 1)"
_ORDER = ["valid_at", "seq", "change_id"]


def _clients(spark, sf_dir):
    """Two in three clients, a row for each."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("updated_at", "source", c)))[c].alias(c)
    return table(spark, sf_dir, "clients").where("client_id % 3 <> 0").groupBy("client_id").agg(last("segment"), last("city"))


@query(f"""with i as (select client_id, arg_max(source, n) as source, arg_max(segment, n) as segment, arg_max(city, n) as city from (select *, row_number() over (order by valid_at nulls first, seq nulls first, change_id nulls first) as n from client_changes) where client_id is not null group by 1)
select client_id, coalesce(i.segment, k.segment) as segment, coalesce(i.city, k.city) as city, k.client_id is null as is_new from i full join {_KNOWN} k using (client_id)""")
def upsert_companies(spark, sf_dir):
    """Clients as companies, their segment as the name, and changes that come in order."""
    return ingest.upsert_companies(_clients(spark, sf_dir), table(spark, sf_dir, "client_changes"), "client_id", "segment", ["city"], _ORDER)


@query(f"""with i as (select client_id, arg_min_null(city, n) as city from (select *, row_number() over (order by valid_at nulls first, seq nulls first, change_id nulls first, city nulls first) as n from client_changes) where client_id is not null group by 1)
select client_id, case when k.client_id is null then i.city else k.city end as city, i.client_id is not null or client_id % 2 = 0 as enabled, k.client_id is null as is_new from i full join {_KNOWN} k using (client_id)""")
def register_boards(spark, sf_dir):
    """Clients as boards of which those with odd ids are off, and changes as registrations."""
    boards = _clients(spark, sf_dir).withColumn("enabled", F.col("client_id") % 2 == 0)
    return ingest.register_boards(boards, table(spark, sf_dir, "client_changes"), ["client_id"], ["city"], _ORDER)
