"""Queries of feed parsers, fetch outcomes and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedding
from ..operators import ingest, search
from ..sources import feeds
from .base import ORACLES, query, table
from .text_queries import canonical_sql, concepts_sql


def _feed_a(spark, sf_dir):
    """Boards of feed A made of parts: one posting in ten has no title."""
    row = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("title"), F.lit("2024-03-01T10:00:00Z").alias("updated_at"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.concat(F.lit("https://jobs.example.com/"), "p_partkey").alias("absolute_url"), F.array(F.struct(F.col("p_type").alias("name"))).alias("departments"), F.concat(F.lit("&lt;p&gt;"), "p_name", F.lit("&lt;/p&gt;")).alias("content"))
    rows = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 20).alias("board_id")).agg(F.collect_list(row).alias("jobs"))
    return rows.select("board_id", F.lit("greenhouse").alias("source"), F.to_json(F.struct("jobs")).alias("body"))


def _feed_b(spark, sf_dir):
    row = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"), F.lit("https://jobs.example.com/b").alias("hostedUrl"), F.unix_millis(F.expr("cast(o_orderdate as timestamp)")).alias("createdAt"), F.when(F.col("o_orderstatus") == "O", "Remote").otherwise("onsite").alias("workplaceType"), F.struct(F.col("o_orderstatus").alias("location"), F.lit("core").alias("team")).alias("categories"), F.lit("text").alias("description"))
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 2000 + 1000).alias("board_id")).agg(F.collect_list(row).alias("jobs"))
    return rows.select("board_id", F.lit("lever").alias("source"), F.to_json("jobs").alias("body"))


def _feed_c(spark, sf_dir):
    row = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.lit("ops").alias("department"), F.lit("Lyon").alias("location"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(True)).when(F.col("s_suppkey") % 3 == 1, F.lit(False)).alias("isRemote"), F.lit("2024-03-01T10:00:00.250+02:00").alias("publishedAt"), F.lit("https://jobs.example.com/c").alias("jobUrl"), F.lit("<p>x</p>").alias("descriptionHtml"))
    rows = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 10 + 200).alias("board_id")).agg(F.collect_list(row).alias("jobs"))
    return rows.select("board_id", F.lit("ashby").alias("source"), F.to_json(F.struct("jobs")).alias("body"))


_OUT = ["board_id", "source", "external_id", "title", "description_html", "location", "remote", "department", "apply_url"]


def _out(rows):
    return rows.select(*_OUT, F.unix_millis("posted_at").alias("posted_ms"))


_A = "select p_partkey % 20 as board_id, 'greenhouse' as source, p_partkey::varchar as external_id, p_name as title, '&lt;p&gt;' || p_name || '&lt;/p&gt;' as description_html, p_brand as location, false as remote, p_type as department, 'https://jobs.example.com/' || p_partkey as apply_url, epoch_ms(timestamp '2024-03-01 10:00:00')::bigint as posted_ms from part where p_partkey % 10 <> 0"
_B = "select o_orderkey % 2000 + 1000 as board_id, 'lever' as source, o_orderkey::varchar as external_id, o_orderpriority as title, 'text' as description_html, o_orderstatus as location, o_orderstatus = 'O' as remote, 'core' as department, 'https://jobs.example.com/b' as apply_url, epoch_ms(o_orderdate)::bigint as posted_ms from orders"
_C = "select s_suppkey % 10 + 200 as board_id, 'ashby' as source, s_suppkey::varchar as external_id, s_name as title, '<p>x</p>' as description_html, 'Lyon' as location, s_suppkey % 3 = 0 as remote, 'ops' as department, 'https://jobs.example.com/c' as apply_url, epoch_ms(timestamp '2024-03-01 08:00:00.250')::bigint as posted_ms from supplier"


@query(_A)
def parse_greenhouse(spark, sf_dir):
    return _out(feeds.parse_greenhouse(_feed_a(spark, sf_dir)))


@query(_B)
def parse_lever(spark, sf_dir):
    return _out(feeds.parse_lever(_feed_b(spark, sf_dir)))


@query(_C)
def parse_ashby(spark, sf_dir):
    return _out(feeds.parse_ashby(_feed_c(spark, sf_dir)))


def _feeds(spark, sf_dir):
    return _feed_a(spark, sf_dir).unionByName(_feed_b(spark, sf_dir)).unionByName(_feed_c(spark, sf_dir))


@query(f"{_A} union all {_B} union all {_C}")
def parse_all_sources(spark, sf_dir):
    return _out(feeds.parse_all(_feeds(spark, sf_dir)))


_STATUS = "case user_id % 6 when 0 then 200 when 1 then 304 when 2 then 404 when 3 then 500 when 4 then 0 end"


@query(f"select event_id, case when ({_STATUS}) is null or ({_STATUS}) = 0 or ({_STATUS}) >= 400 then 'FAILED' when ({_STATUS}) = 304 then 'NOT_MODIFIED' else 'FETCHED' end as outcome from events")
def conditional_fetch_outcome(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", feeds.fetch_outcome(F.expr(_STATUS)).alias("outcome"))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderdate >= timestamp '2000-01-01' and o_orderstatus = 'O'")
def scan_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '2000-01-01' and o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select doc_id, sha256(text) as sha256, true as same from documents where length(text) between 1 and 10485760")
def aes_gcm_roundtrip(spark, sf_dir):
    """Encrypted, decrypted and compared, under the size cap of stored objects."""
    docs = table(spark, sf_dir, "documents").where(F.length("text").between(1, 10 * 1024 * 1024)).select("doc_id", F.col("text").cast("binary").alias("b"))
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    back = F.aes_decrypt(F.aes_encrypt("b", key, F.lit("GCM")), key, F.lit("GCM"))
    return docs.select("doc_id", F.sha2(back, 256).alias("sha256"), (back == F.col("b")).alias("same"))


@query()
def bench_corpus(spark, sf_dir):
    """A seeded corpus of postings of which 15 % are near duplicates of the one before."""
    roles, areas = ["Software Engineer", "Data Engineer", "Site Reliability Engineer", "Product Designer"], ["Payments", "Search", "Identity", "Growth", "Billing"]
    pick = lambda of, seed: F.element_at(F.array(*[F.lit(x) for x in of]), F.pmod(F.xxhash64("base", F.lit(seed)), F.lit(len(of))).cast("int") + 1)
    rows = spark.range(20_000).withColumn("copy", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(100)) < 15)
    rows = rows.withColumn("base", F.when(F.col("copy") & (F.col("id") > 0), F.col("id") - 1).otherwise(F.col("id")))
    title = F.concat_ws(", ", pick(roles, 1), pick(areas, 2))
    return rows.select("id", F.pmod(F.xxhash64("base", F.lit(3)), F.lit(200)).alias("company_id"), F.when(F.col("copy"), F.concat(F.lit("Sr. "), title)).otherwise(title).alias("title"), F.concat(F.lit("Own the "), pick(areas, 2), F.lit(" stack, id "), "base", F.when(F.col("copy"), F.lit(". Apply soon.")).otherwise(F.lit("."))).alias("description"), "copy")


@query("select page_id, sha256(html) as raw_hash, length(html)::bigint as size, 200 as http_status from pages")
def payload_archive(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("raw_hash"), F.length("html").cast("long").alias("size"), F.lit(200).alias("http_status"))


_SPLIT = "select o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 2 = 0 as cur, o_orderkey % 3 = 0 as inc from orders"


def snapshots(spark, sf_dir):
    """Two snapshots of orders: the current one has even keys, the incoming one those divisible by three, of which those
    divisible by four have a new status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_custkey").alias("board"))
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")
    current = orders.where("o_orderkey % 2 = 0").withColumn("h", F.md5(F.concat_ws("|", "o_orderstatus", "o_totalprice"))).withColumn("first_seen_at", at(1)).withColumn("last_seen_at", at(2)).withColumn("closed_at", F.when(F.col("o_orderkey") % 10 == 0, at(2)))
    incoming = orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("h", F.md5(F.concat_ws("|", "o_orderstatus", "o_totalprice")))
    return current, incoming


_CHANGE = "case when o_orderkey % 2 <> 0 then 'first_seen' when o_orderkey % 4 = 0 then 'changed' else 'unchanged' end"


@query(f"select o_orderkey, {_CHANGE} as change from orders where o_orderkey % 3 = 0")
def change_detection(spark, sf_dir):
    current, incoming = snapshots(spark, sf_dir)
    return ingest.changes(current, incoming, ["o_orderkey"], "h").select("o_orderkey", "change")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 4 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice, case when o_orderkey % 2 = 0 then 1 else 9 end as first_day,
  case when o_orderkey % 3 = 0 then 9 else 2 end as last_day, o_orderkey % 3 <> 0 and o_orderkey % 10 = 0 as closed, o_orderkey % 3 = 0 and (o_orderkey % 2 <> 0 or o_orderkey % 4 = 0) as changed, o_orderkey % 2 <> 0 as is_new
  from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0""")
def merge_upsert(spark, sf_dir):
    current, incoming = snapshots(spark, sf_dir)
    rows = ingest.merge(current, incoming, ["o_orderkey"], "h", ["o_orderstatus", "o_totalprice"], F.lit("2024-01-09 00:00:00").cast("timestamp_ntz"))
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice", F.dayofmonth("first_seen_at").alias("first_day"), F.dayofmonth("last_seen_at").alias("last_day"), F.col("closed_at").isNotNull().alias("closed"), "changed", "is_new")


@query("""with c as (select o_orderkey, o_custkey, o_orderkey % 10 = 0 as shut from orders where o_orderkey % 2 = 0), l as (select o_orderkey, o_custkey from orders where o_orderkey % 3 = 0)
select o_orderkey, not shut and o_custkey in (select o_custkey from l) and o_orderkey not in (select o_orderkey from l) as closed_now from c""")
def close_missing(spark, sf_dir):
    current, incoming = snapshots(spark, sf_dir)
    rows = ingest.close_missing(current, incoming, "board", "o_orderkey", F.lit("2024-01-09 00:00:00").cast("timestamp_ntz"))
    return rows.select("o_orderkey", "closed_now")


@query(f"select o_orderkey as aggregate_id, 'jobs.ingested.v1' as topic, o_orderkey::varchar as partition_key, {_CHANGE} as change from orders where o_orderkey % 3 = 0 and ({_CHANGE}) <> 'unchanged'")
def outbox_events(spark, sf_dir):
    """One event for each changed posting; unchanged ones emit nothing."""
    current, incoming = snapshots(spark, sf_dir)
    rows = ingest.changes(current, incoming, ["o_orderkey"], "h").where("change <> 'unchanged'")
    return rows.select(F.col("o_orderkey").alias("aggregate_id"), F.lit("jobs.ingested.v1").alias("topic"), F.col("o_orderkey").cast("string").alias("partition_key"), "change")


_TIERS = "case user_id % 7 when 0 then 429 when 1 then 304 when 2 then 500 else 200 end"


@query(f"""select event_id, case when s = 429 then 'RATE_LIMITED' when s >= 400 then 'FAILED' when s = 304 then 'NOT_MODIFIED' when v % 3 = 0 then 'UNCHANGED_RAW' when v % 3 = 1 and v % 5 = 0 then 'FAILED'
  when v % 2 = 0 then 'UNCHANGED_SEMANTIC' else 'CHANGED' end as outcome from (select event_id, {_TIERS} as s, event_id as v from events)""")
def crawl_outcome(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_TIERS).alias("status"), F.col("event_id").alias("v"))
    raw, semantic = F.when(F.col("v") % 3 == 0, "same").otherwise("new"), F.when((F.col("v") % 3 == 1) & (F.col("v") % 5 == 0), None).when(F.col("v") % 2 == 0, "same").otherwise("new")
    return rows.select("event_id", ingest.crawl_outcome(F.col("status"), raw, F.lit("same"), semantic, F.lit("same")).alias("outcome"))


@query("select event_type as outcome, count(*) as n, round(avg(value), 4) as mean_ms from events group by 1")
def outcome_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_ms"))


@query("select doc_id, left(text, 1000) as error from documents")
def crawl_log(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 1000).alias("error"))


@query("select event_id, (props->>'$.k')::bigint % 10 = 0 as dead, case when (props->>'$.k')::bigint % 10 = 0 then 'events.dlq' else 'events' end as topic from events")
def dead_letter_split(spark, sf_dir):
    """Payloads that can't be read as numbers go to the dead-letter topic with their original bytes."""
    k = F.from_json("props", "k long")["k"]
    rows = table(spark, sf_dir, "events").withColumn("payload", F.when(k % 10 == 0, F.lit("{broken")).otherwise(F.col("props")))
    dead = F.from_json("payload", "k long")["k"].isNull()
    return rows.select("event_id", dead.alias("dead"), F.when(dead, "events.dlq").otherwise("events").alias("topic"))


@query("select count(*) as n_docs, count(distinct doc_id) as n_ids from documents")
def index_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.count_distinct("doc_id").alias("n_ids"))


@query("""select 'resume' as kind, c_custkey as id, c_custkey as resume_id from customer where c_acctbal >= 0
union all select 'request', o_orderkey, case when c_acctbal >= 0 then o_custkey end from orders left join customer on c_custkey = o_custkey""")
def hard_delete(spark, sf_dir):
    """Deleted rows are gone, and what refers to them, or to none, is emptied."""
    resumes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), "c_acctbal")
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resume_id"))
    kept, referring = ingest.hard_delete(resumes, resumes.where("c_acctbal < 0"), "resume_id", requests)
    return kept.select(F.lit("resume").alias("kind"), F.col("resume_id").alias("id"), "resume_id").union(referring.select(F.lit("request"), "id", "resume_id"))


_PLAIN = f"({ORACLES['strip_html']})"
_EMBEDDED = canonical_sql("s_name || ' ' || coalesce(plain, '')")


@query(f"""with d as (select p.page_id, s_suppkey, n_name, s_name, plain, {_EMBEDDED} as c from pages p join {_PLAIN} h on h.page_id = p.page_id join supplier on s_suppkey = p.page_id % 10 + 1 join nation on n_nationkey = s_nationkey)
select page_id, lower(n_name) as company_slug, n_name as company_name, s_name as title, plain as description, array_to_string({concepts_sql('c')}, ' ') as concepts, true as unit, 256 as dimensions from d""")
def build_documents(spark, sf_dir):
    """Pages as canonical jobs of suppliers, and their nations as companies: the documents that are indexed."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("company_id"), F.col("s_name").alias("title"))
    pages = table(spark, sf_dir, "pages").withColumn("s_suppkey", F.col("page_id") % 10 + 1).join(supplier, "s_suppkey")
    jobs = pages.select(F.col("page_id").alias("job_id"), "company_id", "title", F.col("html").alias("description_html"), *[F.lit("").alias(c) for c in ("specialization", "role", "location")], F.lit("MID").alias("level"), F.lit(False).alias("remote"), F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(1).alias("source_count"))
    rows = search.documents(jobs, nation)
    unit = F.abs(embedding.dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-5
    return rows.select(F.col("job_id").alias("page_id"), "company_slug", "company_name", "title", "description", F.array_join("concepts", " ").alias("concepts"), unit.alias("unit"), F.size("embedding").alias("dimensions"))
