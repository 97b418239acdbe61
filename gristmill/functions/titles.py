"""Job titles: level, role family and specialisation by ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jaccard, tokens

# The ladder from its lowest rung, and the last individual contributor's.
LADDER = ["INTERN", "ENTRY", "MID", "SENIOR", "STAFF", "PRINCIPAL", "MANAGER", "DIRECTOR", "VP"]
UNSPECIFIED, LAST_CONTRIBUTOR = "UNSPECIFIED", "PRINCIPAL"

_NUMBERED = r"\b(sde|swe|se|engineer|developer|analyst|scientist|designer)[\s-]*"
# Level rules; the first that is found wins.
LEVELS = [
    (r"\b(vp|vice president|svp|evp)\b", "VP"),
    (r"\b(director|head of)\b", "DIRECTOR"),
    (r"\b(engineering manager|people manager|line manager)\b", "MANAGER"),
    (r"\b(distinguished|fellow|principal)\b", "PRINCIPAL"),
    (r"\bsenior (member of technical staff|mts)\b", "SENIOR"),
    (r"\bsmts\b", "SENIOR"),
    (r"\b(member of technical staff|mts)\b", "MID"),
    (r"\b(staff|lead|tech lead|technical lead)\b", "STAFF"),
    (r"\b(senior|sr|snr)\.?\b", "SENIOR"),
    (r"\b(intern|internship|co-?op|trainee)\b", "INTERN"),
    (r"\b(junior|jr|associate|graduate|new grad|entry level|campus)\b", "ENTRY"),
    (_NUMBERED + r"(iii|3)\b", "SENIOR"),
    (_NUMBERED + r"(ii|2)\b", "MID"),
    (_NUMBERED + r"(i|1)\b", "ENTRY"),
    (r"\blevel[\s-]*3\b", "SENIOR"),
    (r"\blevel[\s-]*2\b", "MID"),
    (r"\blevel[\s-]*1\b", "ENTRY"),
]
# Role rules; the first that is found wins.
ROLES = [
    (r"\b(site reliability|sre|devops|dev ops|platform engineer|infrastructure engineer|production engineer)\b", "site reliability engineer"),
    (r"\b(machine learning|ml|deep learning|ai) engineer\b|\bmle\b", "machine learning engineer"),
    (r"\b(research scientist|research engineer)\b", "research scientist"),
    (r"\bdata scientist\b", "data scientist"),
    (r"\bdata engineer\b", "data engineer"),
    (r"\bdata analyst\b|\bbusiness analyst\b", "data analyst"),
    (r"\b(security engineer|application security|appsec|infosec)\b", "security engineer"),
    (r"\b(sdet|qa engineer|test engineer|quality engineer)\b", "qa engineer"),
    (r"\b(android|ios|mobile) (engineer|developer)\b", "mobile engineer"),
    (r"\b(frontend|front end|front-end|ui) (engineer|developer)\b", "frontend engineer"),
    (r"\b(backend|back end|back-end|server side) (engineer|developer)\b", "backend engineer"),
    (r"\b(full stack|fullstack|full-stack) (engineer|developer)\b", "full stack engineer"),
    (r"\b(technical program manager|tpm)\b", "technical program manager"),
    (r"\b(product manager|pm|product owner)\b", "product manager"),
    (r"\b(product designer|ux designer|ui designer|interaction designer)\b", "product designer"),
    (r"\b(solutions architect|solution architect|sales engineer)\b", "solutions architect"),
    (r"\b(software development engineer|software engineer|software developer|sde|swe|member of technical staff|mts|smts|programmer|developer|engineer|tech lead|technical lead|team lead|engineering lead)\b", "software engineer"),
]
# What is taken from a canonical title first, and what is left over at the end.
REQUISITION = r"\b(req|jr|job)?\s*#\s*\d+\b|\breq\s+\d+\b"
SEPARATOR = r"[|/]|\s-\s"
RUNGS = r"\b(i|ii|iii|iv|v|1|2|3|4|5|l[1-9]|level)\b"
GENERIC = r"\b(and|the|of|for|to|in|at|with|a|an|team|group|org|tech|technical|engineering|software|engineer|developer|member)\b"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def prepared(canonical_title: Column) -> Column:
    text = F.regexp_replace(F.coalesce(canonical_title, F.lit("")), REQUISITION, " ")
    return _squeezed(F.regexp_replace(text, SEPARATOR, " "))


def _first(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, value in rules[1:]:
        out = out.when(text.rlike(pattern), value)
    return out.otherwise(otherwise)


def level(text: Column) -> Column:
    return _first(text, LEVELS, F.lit(UNSPECIFIED))


def role(text: Column) -> Column:
    return _first(text, ROLES, F.when(text == "", F.lit("unknown")).otherwise(text))


def specialization(text: Column) -> Column:
    """What is left without role words, then level words, rungs and generic nouns. Roles go first: the numbered level
    rules hold role nouns and would leave parts of them."""
    for pattern in [*[p for p, _ in ROLES], *[p for p, _ in LEVELS], RUNGS, GENERIC]:
        text = F.regexp_replace(text, pattern, " ")
    return _squeezed(F.regexp_replace(text, "[^a-z0-9+# ]", " "))


def key(level_name: Column, role_name: Column) -> Column:
    return F.concat_ws("|", F.lower(level_name), role_name)


def _rung(level_name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LADDER]), level_name)


def ladder_distance(a: Column, b: Column) -> Column:
    """Rungs between two levels; 0 if one is unspecified."""
    return F.when((_rung(a) == 0) | (_rung(b) == 0), F.lit(0)).otherwise(F.abs(_rung(a) - _rung(b))).cast("int")


def is_contributor(level_name: Column) -> Column:
    return (_rung(level_name) > 0) & (_rung(level_name) <= LADDER.index(LAST_CONTRIBUTOR) + 1)


def title_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0.5 for the role, 0.3 for the level, 0.2 for the specialisation."""
    words = lambda x: F.array_distinct(tokens(x))
    roles = F.when(a["role"] == b["role"], F.lit(1.0)).otherwise(jaccard(words(a["role"]), words(b["role"])))
    levels = 1 - F.least(ladder_distance(a["level"], b["level"]), F.lit(3)) / 3
    special = F.when((a["specialization"] == "") & (b["specialization"] == ""), F.lit(1.0)).otherwise(jaccard(words(a["specialization"]), words(b["specialization"])))
    return 0.5 * roles + 0.3 * levels + 0.2 * special


def rules_sql(text: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    """The rules as a CASE of a SQL dialect with ``regexp_matches``."""
    return "case " + " ".join(f"when regexp_matches({text}, '{p}') then '{v}'" for p, v in rules) + f" else {otherwise} end"


def replaced_sql(text: str, patterns: list[str]) -> str:
    return reduce(lambda inner, p: f"regexp_replace({inner}, '{p}', ' ', 'g')", patterns, text)
