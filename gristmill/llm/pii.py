"""Operator 11: personal data. DataFrame functions only.

Method. Regular expressions propose spans, each kind by itself, leftmost first and without overlap. A validator confirms
them: Luhn's sum for cards, the remainder of 97 for account numbers (IBAN), the range of an address's parts, the number of
digits, no letter or digit right beside the span. A confirmed span has the score of its kind, which known words within
``AROUND`` characters before and after it (as far as the neighbouring matches of its kind) raise, and words of other
numbers lower. Spans of the four base kinds always stay; those of the other kinds stay from ``KEEP`` up, so that a bare
group of digits counts only beside a word that says what it is.

Patterns are written such that a run of characters is entered once, at its start, and never given back, so long runs of
digits, letters or signs take linear time and no recursion. Places come from the lengths of what stands between matches:
nothing is shuffled, and a text is handled in its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .spans import running

AROUND = 40
#: Scores are in hundredths; ``STEP`` is what one sort of words adds or takes.
KEEP, STEP = 50, 30


@dataclass(frozen=True)
class Kind:
    """``pattern`` for Java's expressions and ``plain``, which finds the same, for those that know no possessive forms."""

    name: str
    pattern: str
    plain: str
    score: int
    near: str
    base: bool = False


_OTHER = "version|release|isbn|issn|order|invoice|sku|serial|build"
# ``(?<!..)`` or ``\G`` (where the last match ended) holds at a run's start, so the rest of a run is not tried again.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 90, "e-?mail|mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 60, "ip|address|host|server|client|login", True),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){15,}+", r"[0-9]([\x20-]?[0-9])+", 70, "card|visa|mastercard|amex|credit|debit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 70, "phone|tel|mobile|cell|call|fax|sms", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", 60, "iban|account|bank|transfer|konto"),
    Kind("short_card", r"[0-9](?:[\x20-]?+[0-9]){12,}+", r"[0-9]([\x20-]?[0-9])+", 30, "card|visa|amex|credit|debit"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 30, "ssn|social security|tax id"),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", 30, "phone|tel|mobile|cell|call|fax"),
]
BASE = [k.name for k in KINDS if k.base]
#: Four parts of at most 255, with leading zeros.
IP = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Areas, groups and numbers that are never given out.
NO_SSN = "^(000|666|9..)|-00-|-0000$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = "cast(array() as array<struct<kind_no: int, start: int, end: int, kind: string, score: int>>)"


def _words(words: str) -> str:
    return f"(^|[^a-z])({words})([^a-z]|$)"


def remainder_97(code: Column) -> Column:
    """Of an account number of capital letters and digits, its first four characters moved to the end: 1 if it is valid."""
    moved = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789" + _UPPER), c) - 1
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _confirmed(kind: Kind, m: Column) -> Column:
    found, digits = m["found"], F.translate(m["found"], "+ ().-", "")
    alone = ~m["before"].rlike("[A-Za-z0-9+.-]$") & ~m["after"].rlike("^[A-Za-z0-9]")
    luhn = lambda low, high: F.when(F.length(digits).between(low, high), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    return {
        "email": F.lit(True),
        "ip": found.rlike(IP),
        "card": luhn(16, 19),
        "phone": F.length(digits).between(8, 15),
        "iban": alone & (remainder_97(F.translate(found, " ", "")) == 1),
        "short_card": alone & luhn(13, 15),
        "ssn": alone & ~found.rlike(NO_SSN),
        "local_phone": alone,
    }[kind.name]


def _scored(kind: Kind, m: Column) -> Column:
    around = F.translate(F.concat(m["before"], F.lit(" | "), m["after"]), _UPPER, _LOWER)
    has = lambda words: around.rlike(_words(words)).cast("int") * STEP
    return F.least(F.lit(100), F.greatest(F.lit(0), F.lit(kind.score) + has(kind.near) - has(_OTHER)))


def _listed(kind_no: int, kind: Kind) -> Column:
    """The kept spans of a kind from ``(found, between)``, the matches and the texts around them."""
    found, between = F.col(f"{kind.name}.found"), F.col(f"{kind.name}.between")
    first, rest = F.slice(between, F.lit(1), F.size(found)), F.slice(between, F.lit(2), F.size(found))
    ends = running(F.zip_with(first, found, lambda x, y: F.length(x) + F.length(y)))
    sides = F.zip_with(first, rest, lambda x, y: F.struct(F.right(x, F.lit(AROUND)).alias("before"), F.left(y, F.lit(AROUND)).alias("after")))
    spans = F.zip_with(F.zip_with(ends, found, lambda e, x: F.struct(e.alias("end"), x.alias("found"))), sides, lambda e, s: F.struct(e["end"].alias("end"), e["found"].alias("found"), s["before"].alias("before"), s["after"].alias("after")))
    good = F.filter(spans, lambda m: _confirmed(kind, m))
    out = F.transform(good, lambda m: F.struct(F.lit(kind_no).alias("kind_no"), (m["end"] - F.length(m["found"])).alias("start"), m["end"].alias("end"), F.lit(kind.name).alias("kind"), _scored(kind, m).alias("score")))
    kept = out if kind.base else F.filter(out, lambda m: m["score"] >= KEEP)
    return F.when(F.col(kind.name).isNotNull(), kept).otherwise(F.expr(_NONE))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found)``, a row for each row of ``docs``; ``found`` is an array of (kind_no, start, end, kind, score), in
    code points and end exclusive, by kind as listed and then start. Spans of different kinds may overlap.

    A null or empty text has none. Rows with null or repeated ids have their rows; an empty table gives none. Columns
    other than the two named are not read. Texts are searched whole, in time linear in their length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    proposed = lambda k: F.struct(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias("found"), F.split(text, k.pattern, -1).alias("between"))
    rows = rows.select("doc_id", *[F.when(text.rlike(k.pattern), proposed(k)).alias(k.name) for k in KINDS])
    return rows.select("doc_id", F.concat(*[_listed(n, k) for n, k in enumerate(KINDS)]).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE))
    return rows.select("doc_id", *map(count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = " union all ".join(f"select doc_id, '{k.name}' as kind, {n} as kind_no, string_split_regex(text, {quote(k.plain)}) as parts, regexp_extract_all(text, {quote(k.plain)}) as found from documents where regexp_matches(text, {quote(k.plain)})" for n, k in enumerate(KINDS))
    values = " ".join(f"when '{c}' then {i}" for i, c in enumerate("0123456789" + _UPPER))
    luhn = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when (length(digits) - i) % 2 = 0 then digits[i]::bigint when digits[i]::bigint > 4 then 2 * digits[i]::bigint - 9 else 2 * digits[i]::bigint end)) % 10 = 0"
    scores, near = (" ".join(f"when '{k.name}' then {f(k)}" for k in KINDS) for f in (lambda k: k.score, lambda k: quote(_words(k.near))))
    return f"""
with m as ({listed}
), p as (
  select doc_id, kind, kind_no, unnest(range(1, len(found) + 1)) as i, parts, found from m
), s as (
  select doc_id, kind, kind_no, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::bigint as start, found[i] as found,
    right(parts[i], {AROUND}) as before, left(parts[i + 1], {AROUND}) as after, translate(found[i], '+ ().-', '') as digits from p
), c as (
  select *, not regexp_matches(before, '[A-Za-z0-9+.-]$') and not regexp_matches(after, '^[A-Za-z0-9]') as alone, lower(before || ' | ' || after) as around,
    case when kind in ('card', 'short_card') and length(digits) between 13 and 19 then {luhn} else false end as luhn,
    case when kind = 'iban' then list_reduce(list_transform(string_split(substr(replace(found, ' ', ''), 5) || left(found, 4), ''), lambda c: case c {values} end), lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97) end as rest
  from s
), k as (
  select doc_id, kind, kind_no, start, start + length(found) as stop,
    least(100, greatest(0, case kind {scores} end + case when regexp_matches(around, case kind {near} end) then {STEP} else 0 end - case when regexp_matches(around, {quote(_words(_OTHER))}) then {STEP} else 0 end)) as score
  from c where case kind when 'email' then true when 'ip' then regexp_matches(found, {quote(IP)}) when 'card' then luhn and length(digits) >= 16 when 'phone' then length(digits) between 8 and 15
    when 'iban' then alone and rest = 1 when 'short_card' then alone and luhn and length(digits) <= 15 when 'ssn' then alone and not regexp_matches(found, {quote(NO_SSN)}) else alone end
), g as (
  select doc_id, {', '.join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)},
    string_agg(case when kind_no < {len(BASE)} then kind || ':' || start || ':' || stop end, ',' order by kind_no, start) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by kind_no, start) as spans from k where kind_no < {len(BASE)} or score >= {KEEP} group by 1
)
select d.doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in BASE)}, sha256(coalesce(g.base, '')) as base_sha256, coalesce(g.spans, '') as spans
from documents d left join g on g.doc_id = d.doc_id"""


ORACLE = {"op11_personal_data": _oracle()}
