"""Queries of filters, joins, aggregations, windows and pages over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ingest, lifecycle, schedule
from .base import query, table

NOW = "2024-01-31 00:00:00"
_NTZ = f"timestamp_ntz '{NOW}'"


@query("select c_custkey, c_name from customer where c_acctbal > 0 order by c_custkey")
def enabled_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").orderBy("c_custkey").select("c_custkey", "c_name")


@query("select c_custkey, c_name, n_name from customer join nation on n_nationkey = c_nationkey where lower(c_name) = lower('CUSTOMER#000000007')")
def lookup_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000007")))
    return rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 500")
def open_latest(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey", "o_custkey")


@query(f"select event_id, user_id from events where event_type = 'signup' and ts + interval 20 day > timestamp '{NOW}'")
def active_leases(spark, sf_dir):
    return table(spark, sf_dir, "events").where(f"event_type = 'signup' and ts + interval 20 days > {_NTZ}").select("event_id", "user_id")


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'P'")
def pending_requests(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("with q as (select o_orderkey as id, o_orderdate as due_at from orders), c as (select id from q where due_at <= timestamp '1996-01-01' order by due_at, id limit 25) select id, id in (select id from c) as claimed from q")
def claim_due(spark, sf_dir):
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due_at"))
    claimed, rest = schedule.claim_due(queue, F.expr("timestamp_ntz '1996-01-01 00:00:00'"), 25)
    return claimed.select("id", F.lit(True).alias("claimed")).union(rest.select("id", F.lit(False)))


@query("select event_id from events where event_type = 'error' and value < 50 order by ts, event_id limit 200")
def claim_outbox(spark, sf_dir):
    """Unpublished and not poisoned, oldest first."""
    return table(spark, sf_dir, "events").where("event_type = 'error' and value < 50").orderBy("ts", "event_id").limit(200).select("event_id")


_STATE = "case o_orderstatus when 'O' then 'REQUESTED' when 'P' then 'ACCEPTED' else 'CLOSED' end"


@query("select o_orderkey, o_orderstatus <> 'F' and o_orderdate + interval 14 day < timestamp '2000-01-01' as expires from orders")
def expire_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_STATE).alias("state"), F.expr("o_orderdate + interval 14 days").alias("deadline"))
    due = lifecycle.expire(rows.withColumnRenamed("o_orderkey", "request_id"), "state", "deadline", F.expr("timestamp_ntz '2000-01-01 00:00:00'")).select(F.col("request_id").alias("o_orderkey"), F.lit(True).alias("e"))
    return rows.join(due, "o_orderkey", "left").select("o_orderkey", F.coalesce("e", F.lit(False)).alias("expires"))


_STATES = "case event_type when 'signup' then 'REQUESTED' when 'view' then 'ACCEPTED' when 'click' then 'SUBMITTED' when 'purchase' then 'CLOSED' else 'EXPIRED' end"


def _audit(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(_STATES).alias("state"))


@query(f"select user_id, (epoch_us(min(ts) filter (s = 'ACCEPTED')) // 1000)::bigint as accepted_ms, (epoch_us(min(ts) filter (s = 'SUBMITTED')) // 1000)::bigint as submitted_ms, (epoch_us(min(ts) filter (s in ('DECLINED', 'EXPIRED', 'CLOSED'))) // 1000)::bigint as closed_ms from (select user_id, ts, {_STATES} as s from events) group by 1")
def state_timestamps(spark, sf_dir):
    rows = lifecycle.timestamps(_audit(spark, sf_dir), "user_id", "state", "ts")
    return rows.select("user_id", *[F.expr(f"unix_millis(cast({c}_at as timestamp))").alias(f"{c}_ms") for c in ("accepted", "submitted", "closed")])


@query(f"""select event_id, f as from_state, s as to_state, coalesce((f is null and s = 'REQUESTED') or (f = 'REQUESTED' and s in ('ACCEPTED', 'DECLINED', 'EXPIRED')) or (f = 'ACCEPTED' and s in ('SUBMITTED', 'EXPIRED', 'CLOSED')) or (f = 'SUBMITTED' and s = 'CLOSED'), false) as legal
  from (select event_id, {_STATES} as s, lag({_STATES}) over (partition by user_id order by ts, event_id) as f from events)""")
def fsm_validate(spark, sf_dir):
    rows = lifecycle.validate(_audit(spark, sf_dir), "user_id", ["ts", "event_id"], "state")
    return rows.select("event_id", "from_state", F.col("state").alias("to_state"), "legal")


@query(f"select event_id, user_id, {_STATES} as to_state, row_number() over (partition by user_id order by ts, event_id) as step from events")
def audit_trail(spark, sf_dir):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return _audit(spark, sf_dir).select("event_id", "user_id", F.col("state").alias("to_state"), step.alias("step"))


@query("select p_partkey, p_name from part where p_type like '%ECON%'")
def like_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_type like '%ECON%'").select("p_partkey", "p_name")


@query("select o_orderkey, o_orderdate < timestamp '2000-01-01' as expired, o_orderstatus = 'F' as terminal, o_orderstatus in ('P', 'F') as grants, o_totalprice >= 250000 as duplicate from orders")
def derived_flags(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderdate < timestamp_ntz '2000-01-01 00:00:00'").alias("expired"), (F.col("o_orderstatus") == "F").alias("terminal"), F.col("o_orderstatus").isin("P", "F").alias("grants"), (F.col("o_totalprice") >= 250000).alias("duplicate"))


@query("select l_orderkey, l_linenumber, l_suppkey = 7 or l_partkey = 7 or l_orderkey % 100 = 0 as may_read from lineitem")
def participant_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_suppkey") == 7) | (F.col("l_partkey") == 7) | (F.col("l_orderkey") % 100 == 0)).alias("may_read"))


@query("select s_suppkey, s_name, n_name, r_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def join_board_company(spark, sf_dir):
    """Nations and regions are fixed small tables, which Catalyst broadcasts by their size."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("select event_id, user_id, k from (select event_id, user_id, (props->>'$.k')::bigint as k, row_number() over (partition by user_id, (props->>'$.k')::bigint order by ts, event_id) as n from events where event_type <> 'error') e where n = 1 and not exists (select 1 from events p where p.event_type = 'error' and p.user_id = e.user_id and (p.props->>'$.k')::bigint = e.k)")
def inbox_dedup(spark, sf_dir):
    """The first delivery of each key that hasn't been handled before."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    handled = rows.where("event_type = 'error'").select("user_id", "k").distinct()
    first = ingest.latest(rows.where("event_type <> 'error'"), ["user_id", "k"], F.col("ts"), F.col("event_id"))
    return first.join(handled, ["user_id", "k"], "left_anti").select("event_id", "user_id", "k")


@query("select event_id, (select min(event_id) from events p where p.user_id = e.user_id and p.event_type = e.event_type) as replayed from events e")
def idempotent_replay(spark, sf_dir):
    """Each command's key finds the first request that was made under it."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.min("event_id").over(Window.partitionBy("user_id", "event_type")).alias("replayed"))


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as source_count from customer")
def source_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("source_count"))


@query(f"select o_orderkey, o_custkey from orders where exists (select 1 from events where event_type = 'signup' and ts + interval 20 day > timestamp '{NOW}' and user_id = o_custkey)")
def verified_actor(spark, sf_dir):
    held = active_leases(spark, sf_dir).select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(held, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select count(*) as total, count(*) filter (event_type = 'error') as poisoned, count(*) filter (event_type = 'view' and value > 10) as pending, count(*) filter (value is null) as missing, count(distinct user_id) as users from events")
def ops_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("poisoned"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 10)).alias("pending"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_distinct("user_id").alias("users"))


@query("select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, quantile_disc(value, 0.999) as p999 from events group by 1")
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles, exact."""
    table(spark, sf_dir, "events").createOrReplaceTempView("gristmill_events")
    parts = ", ".join(f"percentile_disc({q}) within group (order by value) as {name}" for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")))
    return spark.sql(f"select event_type, count(*) as n, {parts} from gristmill_events group by event_type")


@query("""with w as (select event_type, unnest(range(0, 5)) as j, ((epoch_us(ts) // 1000) // 60000)::bigint as m from events)
select event_type, ((m - j) * 60000)::bigint as start_ms, count(*) as n, round(count(*) / 300.0, 6)::double as rate from w group by 1, 2""")
def event_rate_5m(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.expr("unix_millis(cast(w.start as timestamp))").alias("start_ms"), "n", F.round(F.col("n") / 300, 6).alias("rate"))


@query("select user_id, (epoch_us(date_trunc('day', ts)) // 1000)::bigint as day_ms, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_daily(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select("user_id", F.expr("unix_millis(cast(w.start as timestamp))").alias("day_ms"), "n", "total")


@query("""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as f from events),
i as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from s)
select user_id, (epoch_us(min(ts)) // 1000)::bigint as start_ms, count(*) as n from i group by user_id, k""")
def sessionize(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return rows.select("user_id", F.expr("unix_millis(cast(first as timestamp))").alias("start_ms"), "n")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders order by place limit 200")
def rank_lists(spark, sf_dir):
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("select o_custkey, o_orderkey, n as place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderdate desc, o_orderkey) as n from orders) where n <= 25")
def shortlist_topk(spark, sf_dir):
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(best).cast("long").alias("place")).where("place <= 25")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_per_key(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "value")


@query("select event_id, coalesce(event_type = lag(event_type) over (partition by user_id order by ts, event_id), false) as unchanged from events")
def payload_unchanged_lag(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.col("event_type") == before, F.lit(False)).alias("unchanged"))


@query("""with c as (select event_id, user_id, ts, (value > 40)::integer as ch from events), i as (select *, sum(ch) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from c)
select event_id, sum(1 - ch) over (partition by user_id, g order by ts, event_id rows unbounded preceding)::bigint as streak from i""")
def unchanged_streak(spark, sf_dir):
    return ingest.unchanged_streak(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 40).select("event_id", "streak")


@query("select event_id, n as used, n <= 2 as allowed from (select event_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as n from events)")
def daily_quota(spark, sf_dir):
    """Every attempt counts, refused ones too."""
    used = F.row_number().over(Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", used.alias("used")).withColumn("allowed", F.col("used") <= 2)


_HOUR = "(epoch_us(ts) // 1000) / 1000.0 / 3600"


@query(f"""with recursive e as (select event_id, user_id, {_HOUR} as h, row_number() over (partition by user_id order by ts, event_id) as n from events),
b as (select event_id, user_id, h, n, (2.0 - 1)::double as tokens, true as allowed from e where n = 1
  union all select event_id, user_id, h, n, case when t >= 1 then t - 1 else t end, t >= 1 from (
    select e.event_id, e.user_id, e.h, e.n, least(2.0::double, b.tokens + greatest(0, e.h - b.h) * 0.1) as t from b join e on e.user_id = b.user_id and e.n = b.n + 1))
select event_id, allowed, round(tokens, 4) as tokens from b""")
def token_bucket(spark, sf_dir):
    """Two tokens at most, one more in ten hours."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.expr("unix_millis(cast(ts as timestamp))") / 1000.0 / 3600).alias("h"))
    rows = schedule.token_bucket(rows, "user_id", "h", ["h", "event_id"], rate=0.1, capacity=2.0)
    return rows.select("event_id", "allowed", F.round("tokens", 4).alias("tokens"))


@query("""with recursive e as (select user_id, value, event_id % 3 as days, row_number() over (partition by user_id order by event_id) as n from events),
r as (select user_id, 0::bigint as n, 1.0::double as rate union all select r.user_id, e.n, case when e.days <= 0 then r.rate else 0.3 * (e.value / e.days) + 0.7 * r.rate end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, round(rate, 5) as rate from (select *, row_number() over (partition by user_id order by n desc) as k from r) where k = 1""".replace("select user_id, 0::bigint as n", "select distinct user_id, 0::bigint as n").replace("as rate union all", "as rate from e union all"))
def ewma_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") % 3).alias("days"))
    return schedule.smoothed_rate(rows, "user_id", "event_id", "value", "days").select("user_id", F.round("rate", 5).alias("rate"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def page_slice(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, rtrim(replace(replace(to_base64((o_orderkey || ':' || left(md5(o_orderkey::varchar), 16))::blob), '+', '-'), '/', '_'), '=') as cursor from orders")
def cursor_codec(spark, sf_dir):
    """A cursor for each offset, decoded again and compared."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(16)).alias("digest"))
    text = F.concat_ws(":", F.col("o_orderkey").cast("string"), "digest")
    rows = rows.withColumn("cursor", F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("=")))
    back = F.unbase64(F.concat(F.translate("cursor", "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length("cursor"), F.lit(4))))).cast("string")
    return rows.where(back == text).select("o_orderkey", "cursor")


@query("select event_id, user_id from events where ts >= timestamp '2024-01-23'")
def retention(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-23 00:00:00'").select("event_id", "user_id")


@query("select user_id, event_id, case when n > 5 then 'REVOKED' when event_type = 'error' then 'PENDING' else 'VERIFIED' end as status, (epoch_us(ts + interval 90 day) // 1000)::bigint as expires_ms from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('error', 'signup'))")
def lease_expiry(spark, sf_dir):
    """Five tries confirm or lock; a confirmed lease lasts 90 days."""
    tries = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).withColumn("n", tries)
    status = F.when(F.col("n") > 5, "REVOKED").when(F.col("event_type") == "error", "PENDING").otherwise("VERIFIED")
    return rows.select("user_id", "event_id", status.alias("status"), F.expr("unix_millis(cast(ts + interval 90 days as timestamp))").alias("expires_ms"))


@query("select o_orderkey, case when o_orderkey % 11 = 0 then 'REPLAYED' when o_custkey % 13 = 0 then 'SELF_REFERRAL' when o_custkey % 3 <> 0 then 'NOT_VERIFIED' when n > 5 then 'NO_CAPACITY' else 'OK' end as reason from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders)")
def command_guard(spark, sf_dir):
    """A command's first failing guard: replay, self, verification, capacity."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    reason = F.when(F.col("o_orderkey") % 11 == 0, "REPLAYED").when(F.col("o_custkey") % 13 == 0, "SELF_REFERRAL").when(F.col("o_custkey") % 3 != 0, "NOT_VERIFIED").when(F.col("n") > 5, "NO_CAPACITY").otherwise("OK")
    return table(spark, sf_dir, "orders").withColumn("n", n).select("o_orderkey", reason.alias("reason"))


@query("select round(100.0 * (count(*) - count(distinct text)) / count(*), 4)::double as collapsed_percent from documents")
def collapse_rate(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.round(100.0 * (F.count("*") - F.count_distinct(F.xxhash64("text"))) / F.count("*"), 4).alias("collapsed_percent"))
