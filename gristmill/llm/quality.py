"""Operator 2: quality rules whose thresholds follow the corpus.

Method. Each text gets its counts in one pass. Of four rates (integers, per mille) a mergeable quantile sketch is kept
per language and source: a histogram with exact buckets below 64 and 32 buckets per power of two from there (relative
error 1/32), so sketches merge by adding counts, in any order, with the same result. They are summed before the shuffle
and rolled up to languages and to the corpus. A rate's bounds are its median plus or minus ``SPREAD`` times the distance
to the upper or lower quartile, and a slack. A source of fewer than ``LEAST`` texts takes its language's bounds, or
those of the corpus. The bounds are joined to the texts' counts; texts themselves aren't moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as V
from .shared import cut, table

SPREAD, LEAST, BROADCAST_GROUPS = 4, 100, 100_000
#: Rate: (numerator, denominator, slack, whether a low value fails too).
RATES = {"word_length": ("word_chars", "n_words", 2500, True), "symbols": ("n_symbols", "n_words", 60, False), "dup_lines": ("n_dup_lines", "n_lines", 200, False), "repeats": ("n_repeat_words", "n_words", 100, False)}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_LEAD = np.r_[np.ones(128, bool), np.zeros(64, bool), np.ones(64, bool)]
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LINE = np.arange(256) != 10


def _repeated(hashes: np.ndarray, n: int) -> int:
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    return int(V.covered(np.flatnonzero(np.isin(hashes, twice)), 5, n).sum())


def text_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, bounds = V.words(data, offsets, V.NOT_SPACE)
    windows = V.window_hashes(V.word_hashes(data, starts, ends), 5)
    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    repeats = [_repeated(windows[a : b - 4], b - a) if b - a > 5 else 0 for a, b in spans]
    inside = V.NOT_SPACE[data]
    of = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
    first, last, _ = V.words(data, offsets, _LINE)
    sums = np.r_[0, np.cumsum(inside)]
    full = sums[last] > sums[first]
    first, last = first[full], last[full]
    lines, at = V.word_hashes(data, first, last), np.searchsorted(first, offsets)
    distinct = [len(np.unique(lines[a:b])) for a, b in zip(at[:-1], at[1:])]
    n_lines = np.diff(at)
    return [np.diff(bounds), of(inside & _LEAD[data]), of(_SYMBOL[data]), n_lines, n_lines - np.array(distinct, np.int64), np.array(repeats, np.int64)]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in V.slices(batch.column(3)):
            columns = [pa.array(x.astype(np.int64)) for x in text_counts(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(j).slice(lo, hi - lo) for j in range(3)] + columns, ["doc_id", "lang", "source", *_COUNTS])


def _bounds(counted: DataFrame) -> DataFrame:
    """The sketches and quartiles by (level, lang, source), one column of bounds per rate."""
    rates = [F.struct(F.lit(name).alias("metric"), F.expr(f"{top} * 1000 div greatest({low}, 1)").alias("value")) for name, (top, low, _, _) in RATES.items()]
    long = counted.where("not base_failed").select("lang", "source", F.explode(F.array(*rates)).alias("x")).select("lang", "source", "x.metric", "x.value")
    bucket = F.when(F.col("value") < 64, F.col("value")).otherwise(F.expr("shiftleft(shiftright(value, length(bin(value)) - 6), length(bin(value)) - 6)"))
    sketch = long.withColumn("bucket", bucket).groupBy("metric", "lang", "source", "bucket").agg(F.count("*").alias("n"))
    levels = [sketch.groupBy("metric", "bucket", *keys).agg(F.sum("n").alias("n")).select("metric", "bucket", "n", F.lit(level).alias("level"), *[F.col(k) if k in keys else F.lit("").alias(k) for k in ("lang", "source")]) for level, keys in ((2, ("lang", "source")), (1, ("lang",)), (0, ()))]
    group = Window.partitionBy("metric", "level", "lang", "source")
    ranked = levels[0].union(levels[1]).union(levels[2]).withColumn("below", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda up, low: F.min(F.when(F.col("below") * low >= F.col("total") * up, F.col("bucket")))
    quartiles = ranked.groupBy("metric", "level", "lang", "source").agg(F.max("total").alias("total"), at(1, 4).alias("q1"), at(1, 2).alias("q2"), at(3, 4).alias("q3"))
    columns = [F.max("total").alias("total")]
    for name, (_, _, slack, _) in RATES.items():
        mine = F.col("metric") == name
        columns.append(F.max(F.when(mine, F.col("q2") + SPREAD * (F.col("q3") - F.col("q2")) + slack)).alias(f"{name}_high"))
        columns.append(F.max(F.when(mine, F.col("q2") - SPREAD * (F.col("q2") - F.col("q1")) - slack)).alias(f"{name}_low"))
    return quartiles.groupBy("level", "lang", "source").agg(*columns)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, ``base_failed`` and ``kept``, a row for each row of ``docs``; columns as in the module's query.

    Words are ended by ASCII white space. A null text has no words, so it fails the base rules. A null language or
    source is the language or source ''. Rows with null or repeated ids have their rows. An empty table gives no rows.
    Where no text passes the base rules there are no bounds and nothing else fails. Columns other than those named are
    not read. The bounds come from all texts that pass the base rules.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    counted = docs.mapInArrow(_count_rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))
    counted = cut(counted.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")))
    bounds = cut(_bounds(counted))
    every = [c for c in bounds.columns if c not in ("level", "lang", "source", "total")]
    small = bounds.count() <= BROADCAST_GROUPS
    near = lambda df: F.broadcast(df) if small else df
    own = bounds.where(f"level = 2 and total >= {LEAST}").select("lang", "source", *[F.col(c).alias(f"{c}_2") for c in every])
    lang = bounds.where(f"level = 1 and total >= {LEAST}").select("lang", *[F.col(c).alias(f"{c}_1") for c in every])
    corpus = bounds.where("level = 0").select(*[F.col(c).alias(f"{c}_0") for c in every])
    rows = counted.join(near(own), ["lang", "source"], "left").join(near(lang), ["lang"], "left").join(F.broadcast(corpus), F.lit(True), "left")
    failed = F.lit(False)
    for name, (top, low, _, both) in RATES.items():
        rate = F.expr(f"{top} * 1000 div greatest({low}, 1)")
        high, least = (F.coalesce(*[F.col(f"{name}_{side}_{level}") for level in (2, 1, 0)]) for side in ("high", "low"))
        failed = failed | F.coalesce(rate > high, F.lit(False))
        if both:
            failed = failed | F.coalesce(rate < least, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~failed).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rates = " union all ".join(f"select lang, source, '{name}' as metric, {top} * 1000 // greatest({low}, 1) as value from counted where not base_failed" for name, (top, low, _, _) in RATES.items())
    bounds = ", ".join(f"max(case when metric = '{name}' then q2 + {SPREAD} * (q3 - q2) + {slack} end) as {name}_high, max(case when metric = '{name}' then q2 - {SPREAD} * (q2 - q1) - {slack} end) as {name}_low" for name, (_, _, slack, _) in RATES.items())
    pick = lambda c: f"coalesce(own.{c}, lng.{c}, al.{c})"
    failed = " or ".join(f"coalesce(d.{top} * 1000 // greatest(d.{low}, 1) > {pick(name + '_high')}, false)" + (f" or coalesce(d.{top} * 1000 // greatest(d.{low}, 1) < {pick(name + '_low')}, false)" if both else "") for name, (top, low, _, both) in RATES.items())
    return rf"""
with w as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents
), g as (
  select doc_id, i, count(*) over (partition by doc_id, g) as n
  from (select doc_id, i, array_to_string(l[i:i+4], ' ') as g from (select doc_id, l, unnest(range(1, len(l) - 3)) as i from w where len(l) >= 5))
), r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from g where n > 1) group by 1
), n as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct s) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as s from w) where regexp_matches(s, '[^\x20\x09-\x0D]') group by 1
), counted as (
  select w.doc_id, w.lang, w.source, len(w.l)::bigint as n_words, len(array_to_string(w.l, ''))::bigint as word_chars,
    len(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n.n_lines, 0)::bigint as n_lines,
    coalesce(n.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words,
    len(w.l) < 10 or 100 * coalesce(r.n_repeat_words, 0) > 20 * len(w.l) as base_failed
  from w left join n on n.doc_id = w.doc_id left join r on r.doc_id = w.doc_id
), v as (
  select lang, source, metric, case when value < 64 then value else (value >> (length(bin(value)) - 6)) << (length(bin(value)) - 6) end as bucket from ({rates})
), h as (
  select 2 as level, metric, lang, source, bucket, count(*) as n from v group by all
  union all select 1, metric, lang, '', bucket, count(*) from v group by all
  union all select 0, metric, '', '', bucket, count(*) from v group by all
), c as (
  select *, sum(n) over (partition by level, metric, lang, source order by bucket) as below, sum(n) over (partition by level, metric, lang, source) as total from h
), q as (
  select level, metric, lang, source, max(total) as total, min(case when below * 4 >= total then bucket end) as q1,
    min(case when below * 2 >= total then bucket end) as q2, min(case when below * 4 >= total * 3 then bucket end) as q3 from c group by 1, 2, 3, 4
), b as (select level, lang, source, max(total) as total, {bounds} from q group by 1, 2, 3)
select d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, not d.base_failed and not ({failed}) as kept
from counted d left join b own on own.level = 2 and own.total >= {LEAST} and own.lang = d.lang and own.source = d.source
left join b lng on lng.level = 1 and lng.total >= {LEAST} and lng.lang = d.lang left join b al on al.level = 0"""


ORACLE = {"op2_quality_rules": _oracle()}
