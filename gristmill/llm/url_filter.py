"""Operator 10: URL rules by a sort-merge range join. DataFrame functions only.

Method. A host's labels are reversed, each followed by a dot (``www.example.org`` gives ``org.example.www.``), so a rule's
host and all its subdomains are one interval of sorted keys, those that begin with ``org.example.``. Behind one host, a
rule's path is an interval in the same way. Intervals of prefixes nest or are apart. Interval ends and points are sorted
together and swept once: the open rules form a stack, a running sum of opened less closed intervals is its height, and
the last rule opened at that height is its top.

Two such sweeps follow each other. The first gives each URL the innermost rule host about it, with the rule hosts about
that one. The second looks up the URL's path behind each of these hosts and finds the longest rule there. The longest of
them, host and path together, gives the verdict. No row ever carries a host's rules, however many they are.

Each sweep is distributed as a prefix scan: rows are range-partitioned by key and row, so that URLs of one host, or of one
address, spread over many parts; each part is swept on its own, and what the parts before it left open is carried in from a
table of one row per part. The rules' own ends are swept in the same way first, so that each end knows what is on top of
the stack behind it; stacks may be of any height.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

#: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The verdict on URLs that no rule fits.
OTHERWISE = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def _parted(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in parts that follow each other in ``order``, which are fixed by a checkpoint."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))


def _tops(rules: DataFrame) -> DataFrame:
    """``(key, top)`` for each end of the rules' intervals: ``top.entry`` is of the innermost rule open from there on, and
    null if none is. ``rules`` has ``key``, binary and unique, and ``entry``. No byte of UTF-8 is FF, so a key and FF comes
    after all that begins with the key."""
    opened = rules.select("key", F.lit(1).alias("step"), F.struct("entry").alias("own"))
    closed = rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(opened.schema["own"].dataType).alias("own"))
    ends = _parted(opened.union(closed), ["key"])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.groupBy("part").agg(F.sum("step").alias("net")).select("part", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    here = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.join(F.broadcast(base), "part").withColumn("height", F.sum("step").over(here.partitionBy("part")) + F.col("base"))
    ends = ends.withColumn("top", F.last("own", ignorenulls=True).over(here.partitionBy("part", "height")))
    # A part whose stack falls to a rule that an earlier part opened: one row per part and height asks for it.
    asked = ends.where("top is null and height > 0").select("part", "height").distinct().select("part", "height", F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["own"].dataType).alias("left_open"))
    left = ends.where("step = 1").groupBy("part", "height").agg(F.max_by("own", "key").alias("left_open")).select("part", "height", F.lit(1).alias("kind"), "left_open")
    earlier = Window.partitionBy("height").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.union(left).withColumn("carried", F.last("left_open", ignorenulls=True).over(earlier)).where("kind = 0").select("part", "height", "carried")
    top = F.coalesce("top", "carried", F.struct(F.lit(None).cast(rules.schema["entry"].dataType).alias("entry")))
    return ends.join(carried, ["part", "height"], "left").select("key", top.alias("top"))


def innermost(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``points`` with ``entry`` of the rule with the longest ``key`` that the point's ``key`` begins with, or null.

    Both keys are binary, of UTF-8 and bytes below FF. A null key fits nothing. ``points`` has a ``row`` to tell rows apart.
    """
    tops = _tops(rules)
    names = [c for c in points.columns if c not in ("key", "row")]
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("row", *names)]
    rows = points.select("key", F.lit(1).alias("kind"), F.lit(None).cast(tops.schema["top"].dataType).alias("top"), "row", *names)
    swept = _parted(tops.select("key", F.lit(0).alias("kind"), "top", *blank).union(rows), ["key", "kind", "row"])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = swept.groupBy("part").agg(F.max_by("top", F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    start = start.select("part", F.last("end", ignorenulls=True).over(before).alias("start"))
    here = Window.partitionBy("part").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = swept.withColumn("top", F.last("top", ignorenulls=True).over(here)).where("kind = 1").join(F.broadcast(start), "part")
    return found.select("key", "row", *names, F.coalesce("top", "start")["entry"].alias("entry"))


def _chains(hosts: DataFrame) -> DataFrame:
    """``(host, chain)``: the rule hosts that are ``host`` or a domain above it, at most one for each of its labels."""
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = hosts.select("host", F.explode(above).alias("above"))
    return pairs.join(hosts.select(F.col("host").alias("above")), "above").groupBy("host").agg(F.collect_set("above").alias("chain"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, a row for each row of ``pages``; ``rules`` has verdict, host and path.

    A null URL, or one without ``://``, has an empty host and path. Rows with null or repeated ids have their rows. Of
    the rules that fit, the longest (host and path together) wins; of equally long ones that with the longer host, and
    of one host and path ``block`` wins over ``allow``. Rules with a null column or an empty host are left out. No rules: all get
    ``otherwise``. No pages: no rows. Columns other than those named are not read.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    points = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.where("verdict is not null and host is not null and path is not null and host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    chains = _chains(rules.select("host").distinct())
    about = innermost(points.withColumn("key", host_key(F.col("host")).cast("binary")), chains.select(host_key(F.col("host")).cast("binary").alias("key"), F.col("chain").alias("entry")))
    # FE is no byte of UTF-8 either: it keeps a rule's host and path apart. URLs in no rule's host have a null key.
    address = lambda host, path: F.concat(host.cast("binary"), F.lit(b"\xfe"), path.cast("binary"))
    probes = about.drop("key").withColumn("domain", F.explode_outer("entry")).drop("entry").withColumn("key", address(F.col("domain"), F.col("path")))
    entry = F.struct(F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("deep"), F.concat("host", "path").alias("rule"), "verdict")
    hits = innermost(probes.drop("domain"), rules.select(address(F.col("host"), F.col("path")).alias("key"), entry.alias("entry")))
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max("entry").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = ", ".join("({})".format(", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule)) for rule in rules)
    return spark.sql(f"select * from values {rows} as t(verdict, host, path)") if rows else spark.sql("select '' as verdict, '' as host, '' as path where false")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = {
    "op10_url_filters": f"""
with r(verdict, host, path) as (values {", ".join(str(x) for x in RULES)}),
u as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages)
), f as (
  select page_id, r.host || r.path as rule, r.verdict, row_number() over (partition by page_id order by length(r.host || r.path) desc, length(r.host) desc) as n
  from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
)
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, '{OTHERWISE}') as verdict from u left join f on f.page_id = u.page_id and f.n = 1""",
}
