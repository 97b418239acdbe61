"""Scores and gates: duplicates, search ranking, trust, matching, crawl intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jaccard, tokens
from .titles import UNSPECIFIED, is_contributor, ladder_distance


@dataclass(frozen=True)
class DedupDials:
    jaccard: float = 0.45
    title: float = 0.30
    company: float = 0.15
    location: float = 0.10
    threshold: float = 0.82
    candidates: int = 200
    shortlist: int = 25

    def __post_init__(self):
        if abs(self.jaccard + self.title + self.company + self.location - 1) > 1e-6:
            raise ValueError("the weights must sum to 1")


def company_gate(company: Column) -> Column:
    return F.when(company >= 1, F.lit(1.0)).otherwise(F.lit(0.0))


def level_gate(a: Column, b: Column) -> Column:
    distance = ladder_distance(a, b)
    return (
        F.when((a == UNSPECIFIED) | (b == UNSPECIFIED), F.lit(1.0)).when(is_contributor(a) != is_contributor(b), F.lit(0.0))
        .when(distance == 0, F.lit(1.0)).when(distance == 1, F.lit(0.85)).when(distance == 2, F.lit(0.35)).otherwise(F.lit(0.0))
    )


def location_score(a: Column, b: Column, a_remote: Column, b_remote: Column) -> Column:
    words_a, words_b = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return (
        F.when(a_remote & b_remote, F.lit(1.0)).when((a == "") & (b == ""), F.lit(0.5)).when((a == "") | (b == ""), F.lit(0.3))
        .when(a == b, F.lit(1.0)).when(F.contains(a, b) | F.contains(b, a), F.lit(0.8))
        .when(F.arrays_overlap(words_a, words_b), 0.4 + 0.4 * jaccard(words_a, words_b))
        .when(a_remote != b_remote, F.lit(0.0)).otherwise(F.lit(0.1))
    )


def location_gate(a: Column, b: Column, a_remote: Column, b_remote: Column, score: Column) -> Column:
    return (
        F.when(a_remote != b_remote, F.lit(0.0)).when(score >= 0.8, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.9))
        .when(score >= 0.4, F.lit(0.85)).otherwise(F.lit(0.25))
    )


def duplicate_score(text: Column, title: Column, company: Column, location: Column, gates: Column, dials: DedupDials = DedupDials()) -> Column:
    return (dials.jaccard * text + dials.title * title + dials.company * company + dials.location * location) * gates


def rrf(ranks: list[tuple[Column, float]], k: int = 60) -> Column:
    """The fused score of a row from its rank in each list (null: not in it)."""
    out = F.lit(0.0)
    for rank, weight in ranks:
        out = out + F.coalesce(F.lit(weight) / (k + rank), F.lit(0.0))
    return out


def freshness(posted: Column, now: Column, half_life_days: float = 14.0) -> Column:
    """Halves with each half-life; 1 without a date or with one to come."""
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(posted.cast("timestamp"))
    return F.when(posted.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / (half_life_days * 86_400_000)))


def bounded_freshness(multiplier: Column, penalty: float = 0.4) -> Column:
    penalty = min(max(penalty, 0.0), 1.0)
    return 1 - penalty * (1 - multiplier)


def wilson(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower bound of the success rate; 0 without trials."""
    n = trials.cast("double")
    p = F.least(F.greatest(successes, F.lit(0)), trials) / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(trials <= 0, F.lit(0.0)).otherwise(F.greatest(bound, F.lit(0.0)))


def response_score(received: Column, responded: Column) -> Column:
    return F.when(received <= 0, F.lit(0.5)).otherwise(wilson(responded, received))


def completion_score(completed: Column, accepted: Column) -> Column:
    return F.when(accepted <= 0, F.lit(0.5)).otherwise(wilson(completed, accepted))


def reputation(response: Column, completion: Column) -> Column:
    return 0.4 * response + 0.6 * completion


def seniority_fit(role: Column, referrer: Column) -> Column:
    """How well a referrer's level suits a role's, by rungs above it."""
    from .titles import LADDER

    rung = lambda x: F.array_position(F.array(*[F.lit(v) for v in LADDER]), x)
    gap = rung(referrer) - rung(role)
    unknown = (F.coalesce(rung(role), F.lit(0)) == 0) | (F.coalesce(rung(referrer), F.lit(0)) == 0)
    return (
        F.when(unknown, F.lit(0.5)).when(gap < 0, F.greatest(F.lit(0.0), 0.5 + 0.25 * gap)).when(gap <= 1, F.lit(1.0))
        .when(gap == 2, F.lit(0.75)).when(gap == 3, F.lit(0.5)).otherwise(F.lit(0.25))
    )


@dataclass(frozen=True)
class MatchWeights:
    org: float = 0.30
    stack: float = 0.25
    seniority: float = 0.15
    reputation: float = 0.30
    fairness: float = 0.45


def affinity(org: Column, stack: Column, seniority: Column, standing: Column, weights: MatchWeights = MatchWeights()) -> Column:
    total = weights.org + weights.stack + weights.seniority + weights.reputation
    return (weights.org * org + weights.stack * stack + weights.seniority * seniority + weights.reputation * standing) / total


@dataclass(frozen=True)
class Pace:
    shortest_s: float = 300.0
    longest_s: float = 43_200.0
    per_visit: float = 3.0
    backoff: float = 1.6
    most_backoffs: int = 6
    idle: float = 1e-4
    alpha: float = 0.3


def next_interval_ms(rate_per_day: Column, unchanged: Column, current_ms: Column, pace: Pace = Pace()) -> Column:
    """Milliseconds to the next visit, whole at each step: by the rate of postings, longer after each visit without a
    change, and at most half or twice the present interval (null or 0: there is none yet)."""
    low, high = int(pace.shortest_s * 1000), int(pace.longest_s * 1000)
    clamp = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)).cast("long")
    by_rate = F.floor(F.least(F.lit(86_400_000 * pace.per_visit) / F.greatest(rate_per_day, F.lit(pace.idle)), F.lit(float(high))))
    base = clamp(F.when(rate_per_day <= pace.idle, F.lit(high)).otherwise(by_rate))
    steps = F.least(F.greatest(unchanged, F.lit(0)), F.lit(pace.most_backoffs))
    grown = F.floor(F.least(base * F.pow(F.lit(pace.backoff), steps), F.lit(float(high))))
    damped = F.greatest(F.floor(current_ms / 2), F.least(current_ms * 2, grown))
    return clamp(F.when(current_ms > 0, damped).otherwise(grown))


def next_rate(rate: Column, seen: Column, days: Column, alpha: float = Pace.alpha) -> Column:
    return F.when(days <= 0, rate).otherwise(alpha * (seen / days) + (1 - alpha) * rate)
