"""Operator 6: secret scans. DataFrame functions only.

Method. Three base kinds are found by pattern. Beside them, each run of at least ``WINDOW`` characters of
``[A-Za-z0-9+/_=-]`` is a candidate: it is of the class ``hex`` if it has hex digits only, of the class ``mixed`` if it
has a letter and a digit, of the class ``letters`` if it has small and capital letters and no digit, and else of none. Runs
of hex digits of one case within a candidate are measured by themselves too. A window of ``WINDOW`` characters slides; its Shannon entropy is ``log2(WINDOW) - sum(c * log2(c)) / WINDOW`` over the counts c of its characters. The
counts and that sum are kept in a fold: one character comes in, one goes out, and the sum changes by table lookups. The
table holds whole millionths, so sums are exact whatever the order. A candidate is reported if its best window reaches
its class's bound and no allow-list pattern matches it.

Places come from the text between matches: a match begins where the lengths of what stands before it add up to. So
nothing is shuffled, and a text is handled in its own row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .spans import bound, running

WINDOW = 20
#: Bits of entropy of the best window from which a candidate is reported, by class.
BITS = {"hex": 3.0, "mixed": 3.7, "letters": 4.0}
_ANY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALPHABETS = {"hex": "0123456789abcdef", "mixed": _ANY, "letters": _ANY}
#: C * log2(c) in millionths, for c = 0 to WINDOW + 1, as one character comes in before another goes out.
TERMS = [0, *(round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 2))]
MOST = {kind: math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6) for kind, bits in BITS.items()}
#: Not secrets: examples, placeholders, and paths or slugs of four parts or more, each all letters or all digits.
ALLOWED = ["EXAMPLE", "[Xx]{6}", "0{12}", "^[-/_=]*([A-Za-z]+|[0-9]+)([-/_]([A-Za-z]+|[0-9]+)){3,}[-/_=]*$"]


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The lengths are in the patterns: what follows within a run that is too short is shorter still.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
HEX_RUN = "[0-9a-f]{%d,}|[0-9A-F]{%d,}" % (WINDOW, WINDOW)
KINDS = ["assign", "access", "hex", "entropy"]


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost matches that don't overlap, in code points."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start: int, end: int, found: string>>)")
    both = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda x, y: F.length(x) + F.length(y))
    listed = F.zip_with(running(both), found, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("found")))
    return F.when(text.rlike(pattern), listed).otherwise(none)


def _term(count: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in TERMS]), count + 1)


def _least_sum(text: Column, alphabet: str) -> Column:
    """The smallest sum of c * log2(c) over the windows of a candidate of one class. The fold runs over what comes in and
    goes out at each step, so its state is the counts of one window and two numbers, however long the candidate is."""
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("total"), F.lit(2**31 - 1).alias("least"))

    def step(state: Column, p: Column) -> Column:
        comes, goes = p["comes"], p["goes"]
        had = F.element_at(state["counts"], comes)
        loses = F.element_at(state["counts"], F.greatest(goes, F.lit(1))) + (goes == comes).cast("int")
        total = state["total"] + _term(had + 1) - _term(had) + F.when(goes > 0, _term(loses - 1) - _term(loses)).otherwise(F.lit(0))
        counts = F.transform(state["counts"], lambda n, j: n + (j + 1 == comes).cast("int") - (j + 1 == goes).cast("int"))
        least = F.when(p["full"], F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

    def folded(places: Column) -> Column:
        goes = F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), places), F.lit(1), F.size(places))
        pairs = F.zip_with(places, goes, lambda c, g: F.struct(c.alias("comes"), g.alias("goes")))
        pairs = F.transform(pairs, lambda p, i: F.struct(p["comes"].alias("comes"), p["goes"].alias("goes"), (i + 1 >= WINDOW).alias("full")))
        return F.aggregate(pairs, zero, step, lambda state: state["least"])

    return bound(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c)), folded)


def _reported(found: Column) -> Column:
    hex_only = found.rlike("^[0-9a-fA-F]+$")
    digit, letter = found.rlike("[0-9]"), found.rlike("[A-Za-z]")
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | found.rlike(pattern)
    least = F.when(hex_only, _least_sum(F.lower(found), ALPHABETS["hex"]) <= MOST["hex"])
    least = least.when(digit & letter, _least_sum(found, ALPHABETS["mixed"]) <= MOST["mixed"])
    least = least.when(~digit & found.rlike("[a-z]") & found.rlike("[A-Z]"), _least_sum(found, ALPHABETS["letters"]) <= MOST["letters"])
    runs = F.regexp_extract_all(found, F.lit(HEX_RUN), F.lit(0))
    within = ~hex_only & found.rlike(HEX_RUN) & F.exists(runs, _single(lambda run: _least_sum(F.lower(run), ALPHABETS["hex"]) <= MOST["hex"]))
    return ~allowed & (F.coalesce(least, F.lit(False)) | within)


def _single(f):
    """``f`` as a function of one argument, which is how many Spark counts."""
    return lambda m: f(m)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, secrets)``, a row for each row of ``docs``; ``secrets`` is an array of (start, kind_no, end, kind), in
    code points and end exclusive, by start and then kind. Spans of different kinds may overlap.

    A null or empty text has none. Rows with null or repeated ids have their rows; an empty table gives none. Columns
    other than the two named are not read. Texts are scanned whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    text = F.col("text")
    keep = {
        "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6),
        "access": (ACCESS, lambda m: F.lit(True)),
        "hex": (HEX, lambda m: F.lit(True)),
        "entropy": (CANDIDATE, lambda m: _reported(m["found"])),
    }
    spans = []
    for number, kind in enumerate(KINDS):
        pattern, good = keep[kind]
        listed = F.transform(F.filter(_matches(text, pattern), _single(good)), _single(lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind"))))
        none = F.expr("cast(array() as array<struct<start: int, kind_no: int, end: int, kind: string>>)")
        spans.append(F.when(text.rlike(pattern), listed).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("secrets"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind_no"] < 3)
    return rows.select("doc_id", *map(count, KINDS[:3]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    terms = "[" + ", ".join(map(str, TERMS)) + "]"
    listed = " union all ".join(f"select doc_id, '{kind}' as kind, {n} as kind_no, string_split_regex(text, {quote(p)}) as parts, regexp_extract_all(text, {quote(p)}) as found from t where regexp_matches(text, {quote(p)})" for n, (kind, p) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE))))
    bounds = " ".join(f"when '{kind}' then {most}" for kind, most in MOST.items())
    allowed = " or ".join(f"regexp_matches(found, {quote(p)})" for p in ALLOWED)
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents where regexp_matches(coalesce(text, ''), {quote(ASSIGN)} ) or regexp_matches(coalesce(text, ''), {quote(ACCESS + '|' + HEX + '|' + CANDIDATE)})
), m as ({listed}
), p as (
  select doc_id, kind, kind_no, unnest(range(1, len(found) + 1)) as i, parts, found from m
), s as (
  select doc_id, kind, kind_no, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::bigint as start, found[i] as found from p
), f as (
  select doc_id, start, found, regexp_matches(found, '^[0-9a-fA-F]+$') as hex_only, regexp_matches(found, '[0-9]') as digit from s where kind = 'entropy' and not ({allowed})
), c as (
  select doc_id, start, case when hex_only then 'hex' when digit and regexp_matches(found, '[A-Za-z]') then 'mixed' when not digit and regexp_matches(found, '[a-z]') and regexp_matches(found, '[A-Z]') then 'letters' end as class, case when hex_only then lower(found) else found end as chars from f
  union select doc_id, start, 'hex', lower(unnest(regexp_extract_all(found, {quote(HEX_RUN)}))) from f where not hex_only
), w as (
  select doc_id, start, class, chars, unnest(range(1, length(chars) - {WINDOW - 2})) as j from c where class is not null
), n as (
  select doc_id, start, class, chars, j, ch, count(*) as n from (select doc_id, start, class, chars, j, unnest(string_split(substr(chars, j, {WINDOW}), '')) as ch from w) group by all
), e as (
  select doc_id, start from (select doc_id, start, class, chars, j, sum({terms}[n + 1]) as total from n group by all)
  group by doc_id, start, class having min(total) <= case class {bounds} end
), k as (
  select doc_id, kind, kind_no, start, start + length(found) as stop from s
  where (kind = 'assign' and length(regexp_extract(found, {quote(ASSIGN)}, 2)) >= 6) or kind in ('access', 'hex')
    or (kind = 'entropy' and exists (select 1 from e where e.doc_id = s.doc_id and e.start = s.start))
), g as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(case when kind_no < 3 then kind || ':' || start || ':' || stop end, ',' order by start, kind_no) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) as spans from k group by 1
)
select d.doc_id, coalesce(g.n_assign, 0) as n_assign, coalesce(g.n_access, 0) as n_access, coalesce(g.n_hex, 0) as n_hex, sha256(coalesce(g.base, '')) as base_sha256, coalesce(g.spans, '') as spans
from documents d left join g on g.doc_id = d.doc_id"""


ORACLE = {"op6_secret_scan": _oracle()}
