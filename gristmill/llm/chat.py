"""Operator 3: chat formatting with perspective rotation. DataFrame functions only.

Method. A dialogue is rendered once for each participant: that speaker's turns as the assistant's, the others' as turns
of named users, system turns as system turns in each. The mask lists the spans of the assistant's texts with their end
mark. Their places need no second pass over the text: in a perspective, a turn begins at the length of all turns before
it rendered as users', plus the difference of the two headers for each earlier turn of the speaker. Both are running
sums, so masks together are as long as the dialogue has turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

SYSTEM, END = "system", "<|end|>\n"
SYSTEM_HEAD, ASSISTANT_HEAD = "<|system|>\n", "<|assistant|>\n"


def _user_head(speaker: Column) -> Column:
    return F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, speaker, rendered, mask, n_turns)``: a row for each participant of each dialogue, where ``mask`` is an
    array of (start, end), in code points and end exclusive, of what the assistant says.

    Turns are in order of the turn number, then speaker, then text; a null turn number comes first, and repeated rows
    stay as repeated turns. A null text is empty, a null speaker is named ``unknown``. Rows with a null dialogue id are
    one dialogue. System turns belong to no participant; a dialogue of only such turns has no row. An empty table gives
    no rows. Columns other than those named are not read. Texts are rendered whole.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    system = F.col("speaker") == SYSTEM
    head = F.when(system, F.lit(SYSTEM_HEAD)).otherwise(_user_head(F.col("speaker")))
    size = F.length(head) + F.length("text") + len(END)
    order = ["turn", "speaker", "text"]
    talk = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("conv_id", "speaker").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", head.alias("head"), size.cast("long").alias("size"))
    rows = rows.select("*", F.sum("size").over(talk).alias("upto"), F.count("*").over(talk).alias("place"), F.count("*").over(own).alias("nth"))
    shorter = F.length("head") - len(ASSISTANT_HEAD)
    start = F.col("upto") - F.col("size") - (F.col("nth") - 1) * shorter + len(ASSISTANT_HEAD)
    rows = rows.select("conv_id", F.struct("place", "speaker", "head", "text", start.alias("start"), (start + F.length("text") + len(END)).alias("end")).alias("m"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    speakers = F.array_distinct(F.filter(F.transform("m", lambda m: m["speaker"]), lambda s: s != SYSTEM))
    talks = talks.select("conv_id", "m", F.explode(speakers).alias("speaker"))
    mine = lambda m: m["speaker"] == F.col("speaker")
    text = F.array_join(F.transform("m", lambda m: F.concat(F.when(mine(m), F.lit(ASSISTANT_HEAD)).otherwise(m["head"]), m["text"], F.lit(END))), "")
    mask = F.transform(F.filter("m", mine), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return talks.select("conv_id", "speaker", text.alias("rendered"), mask.alias("mask"), F.size("m").cast("long").alias("n_turns"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("conv_id", "speaker", "rendered", spans.alias("mask"), masked.alias("n_masked"), "n_turns")


ORACLE = {
    "op3_chat_rotation": f"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as place
  from conversations
), p as (select distinct conv_id, speaker from t where speaker <> '{SYSTEM}'
), r as (
  select p.conv_id, p.speaker, t.place, p.speaker = t.speaker as mine, length(t.text) + {len(END)} as said,
    (case when t.speaker = '{SYSTEM}' then '{SYSTEM_HEAD.strip()}' when p.speaker = t.speaker then '{ASSISTANT_HEAD.strip()}' else '<|user name=' || t.speaker || '|>' end) || chr(10) || t.text || '{END.strip()}' || chr(10) as piece
  from p join t on p.conv_id is not distinct from t.conv_id
), s as (
  select *, sum(length(piece)) over (partition by conv_id, speaker order by place) as upto from r
)
select conv_id, speaker, string_agg(piece, '' order by place) as rendered,
  string_agg(case when mine then (upto - said)::bigint::varchar || '-' || upto::bigint::varchar end, ',' order by place) as mask,
  sum(case when mine then said end)::bigint as n_masked, count(*)::bigint as n_turns
from s group by conv_id, speaker""",
}
