"""Operator 12: three-way merge of two branches of a table, as SQL over exploded units.

Method. A branch is a rule: a code for each named unit of a row (the row itself, its columns, its text's lines) says what
the branch did to it. Rows are dealt out by key, their lines are exploded by ``posexplode``, each with the gap that
follows it, both branches' codes are reckoned for each line, and CASE expressions merge line and gap: a change of one
branch, or an equal one of both, is taken and counts as clean; unlike changes are a conflict and keep base's state. What
is left of each line is gathered by an ordered ``collect_list`` beside the sums of conflicts. Texts are moved once, whole;
the grouping after the explosion uses the dealing out that is there already. Rows that branches add have one unit and are
grouped by the ids that they get, in a second, narrow part without texts.

A group is one row's lines, or the additions under one id, which are combined before they are dealt out. So no task holds
more than its share, and nothing goes to the driver or into a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc32_sql, table

BRANCHES = ("L", "R")
CODES = 11
COLUMNS = ("lang", "source")


def _crc(text: str) -> str:
    return f"crc32(cast({text} as binary))"


def _codes(crc, name: str, alias: str) -> str:
    """Both branches' codes of the unit that ``name`` names."""
    return ", ".join(f"{crc(f"concat('{b}:', id, ':', {name})")} % {CODES} as {alias}_{b.lower()}" for b in BRANCHES)


def _edited(value: str, code: str) -> str:
    return f"case {code} when 0 then '' when 1 then concat({value}, '!') when 2 then concat({value}, '?') else {value} end"


def _statement(columns: Sequence[str], nth: str, lines: str, gathered: str, crc=_crc) -> str:
    """The merge in SQL from ``base`` (doc_id, id, c0, c1, ... for the columns, text; without nulls but in doc_id).
    ``nth`` tells rows of one id apart, ``lines`` explodes the rows of ``edited`` into n and line, ``gathered`` joins pieces:
    where the dialects differ. What adds rows must not see ``nth``: Spark moves all rows once more for a common table
    expression that isn't deterministic and is used twice."""
    named = {f"c{i}": name for i, name in enumerate(columns)}
    each = lambda f, by=", ": by.join(map(f, named))
    changed = lambda x: "(" + each(lambda c: f"{c}_{x} <> {c}", " or ") + ")"
    merged = lambda c: f"case when {c}_l = {c}_r or {c}_r = {c} then {c}_l when {c}_l = {c} then {c}_r else {c} end"
    count = lambda test: f"case when {test} then 1 else 0 end"
    any_change, one_sided = (lambda c: f"({c}_l <> {c} or {c}_r <> {c})"), (lambda c: f"({c}_l = {c} or {c}_r = {c} or {c}_l = {c}_r)")
    clean_columns, unlike_columns = (each(lambda c: count(f"{any_change(c)} and {no}{one_sided(c)}"), " + ") for no in ("", "not "))
    whole = each(lambda c: f"{c}, {c}_l, {c}_r")
    return f"""
coded as (
  select *, {_codes(crc, "'row'", "row")}, {each(lambda c: _codes(crc, f"'{named[c]}'", f"{c}_code"))} from base
), edited as (
  select doc_id, id, {nth} as nth, text, {each(str)}, row_l = 0 as gone_l, row_r = 0 as gone_r, {each(lambda c: ", ".join(f"{_edited(c, f'{c}_code_{x}')} as {c}_{x}" for x in "lr"))} from coded
), units as (
  select doc_id, nth, gone_l, gone_r, {whole}, n, line, {_codes(crc, "n", "code")} from {lines}
), states as (
  select *, gone_l or gone_r as gone, least(code_l, 3) as line_l, least(code_r, 3) as line_r, case when code_l in (3, 4) then code_l else 0 end as gap_l, case when code_r in (3, 4) then code_r else 0 end as gap_r from units
), decided as (
  select *, line_l < 3 or line_r < 3 as line_any, gap_l > 0 or gap_r > 0 as gap_any,
    case when gone then 3 when line_l = line_r or line_r = 3 then line_l when line_l = 3 then line_r else 3 end as line_to,
    case when gone then 0 when gap_l = gap_r or gap_r = 0 then gap_l when gap_l = 0 then gap_r else 0 end as gap_to,
    line_l < 3 and line_r < 3 and line_l <> line_r as line_unlike, gap_l > 0 and gap_r > 0 and gap_l <> gap_r as gap_unlike from states
), pieces as (
  select *, case when line_to > 0 or gap_to > 0
    then concat_ws(chr(10), case line_to when 0 then null when 1 then concat(line, '!') when 2 then concat(line, '?') else line end, case gap_to when 3 then '!' when 4 then '?' end) end as piece from decided
), gathered as (
  select doc_id, nth, gone_l, gone_r, {whole}, {gathered} as text,
    max({count("line_l < 3 or gap_l > 0")}) as lines_l, max({count("line_r < 3 or gap_r > 0")}) as lines_r,
    sum({count("line_any and not line_unlike")} + {count("gap_any and not gap_unlike")}) as clean, sum({count("gap_unlike")}) as insert_insert,
    sum({count("line_unlike and line_l > 0 and line_r > 0")}) as edit_edit, sum({count("line_unlike and (line_l = 0 or line_r = 0)")}) as edit_delete
  from pieces group by doc_id, nth, gone_l, gone_r, {whole}
), judged as (
  select *, gone_l or gone_r as gone, (gone_l and not gone_r and (lines_r = 1 or {changed("r")})) or (gone_r and not gone_l and (lines_l = 1 or {changed("l")})) as stands from gathered
), kept as (
  select doc_id, {each(lambda c: f"case when stands then {c} when not gone then {merged(c)} end as {c}")}, case when stands or not gone then text end as text,
    case when stands then 0 when gone then 1 else clean + {clean_columns} end as n_clean, case when gone then 0 else edit_edit + {unlike_columns} end as n_edit_edit,
    case when stands then 1 when gone then 0 else edit_delete end as n_edit_delete, case when gone then 0 else insert_insert end as n_insert_insert from judged
), added as (
  select -1 - doc_id as doc_id, {each(str)}, row_l as code from coded where row_l in (3, 4) union all select -2 - doc_id, {each(str)}, row_r from coded where row_r in (3, 4)
), alike as (
  select doc_id, min(code) as code, {each(lambda c: f"min({c}) as {c}")}, min(code) = max(code) and {each(lambda c: f"min({c}) = max({c})", " and ")} as same from added group by doc_id
), merged as (
  select doc_id, {each(str)}, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert from kept
  union all select doc_id, {each(lambda c: f"case when same then {c} end")}, case when same then case code when 3 then '!' else '?' end end, {count("same")}, 0, 0, {count("not same")} from alike
)"""


def _counts() -> str:
    return ", ".join(f"cast({c} as bigint) as {c}" for c in ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"))


def merge(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, the columns, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert)``: a row for each row of ``docs``
    and for each id under which a branch adds a row; a row that is gone, or an addition in conflict, has nulls.

    A unit's code is crc32 of ``branch:id:name`` modulo ``CODES``. Nulls become empty first, in the id's name too; a null or
    empty text is one empty line. What a row with a null id adds comes under a null id. Rows with repeated ids are merged
    each by itself and have a row each; what they add under one id is one row if it is all alike, else a conflict. An
    addition under an id that the table has is a row beside it. An empty table gives none. Columns other than those named
    are not read. Texts are merged whole.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[value(c).alias(f"c{i}") for i, c in enumerate(columns)], value(text_col).alias("text"))
    lines = "(select * from edited distribute by doc_id, nth) lateral view posexplode(split(text, '\\n', -1)) u as n, line"
    gathered = "array_join(transform(array_sort(collect_list(case when piece is not null then struct(n, piece) end)), p -> p.piece), chr(10))"
    sql = f"with base as (select *, coalesce(cast(doc_id as string), '') as id from {{docs}}), {_statement(columns, 'monotonically_increasing_id()', lines, gathered)} select * from merged"
    out = docs.sparkSession.sql(sql, docs=rows)
    return out.select("doc_id", *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "text", *[F.col(n).cast("long").alias(n) for n in ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")])


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def _oracle() -> str:
    lines = "(select *, unnest(range(0, len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from edited)"
    statement = _statement(COLUMNS, "row_number() over ()", lines, "coalesce(string_agg(piece, chr(10) order by n), '')", crc32_sql)
    return f"""
with base as (select doc_id, coalesce(doc_id::varchar, '') as id, coalesce(lang, '') as c0, coalesce(source, '') as c1, coalesce(text, '') as text from documents), {statement}
select doc_id, c0 as lang, c1 as source, sha256(text) as text_sha256, {_counts()} from merged"""


ORACLE = {"op12_branch_merge": _oracle()}
