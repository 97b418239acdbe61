"""Change detection and keyed merges of snapshots, as functions of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crawl_outcome(status: Column, raw_hash: Column, last_raw: Column, semantic_hash: Column, last_semantic: Column) -> Column:
    """The cheapest test first. A failed fetch or parse is FAILED, never an empty board."""
    return (
        F.when(status == 429, "RATE_LIMITED").when(status.isNull() | (status >= 400), "FAILED").when(status == 304, "NOT_MODIFIED")
        .when(raw_hash.eqNullSafe(last_raw), "UNCHANGED_RAW").when(semantic_hash.isNull(), "FAILED")
        .when(semantic_hash.eqNullSafe(last_semantic), "UNCHANGED_SEMANTIC").otherwise("CHANGED")
    )


def changes(current: DataFrame, incoming: DataFrame, key: list[str], hash_col: str) -> DataFrame:
    """The rows of ``incoming`` with ``change``: first_seen, changed or unchanged."""
    old = current.select(*key, F.col(hash_col).alias("__old"), F.lit(True).alias("__known"))
    rows = incoming.join(old, key, "left")
    change = F.when(F.col("__known").isNull(), "first_seen").when(F.col(hash_col).eqNullSafe(F.col("__old")), "unchanged").otherwise("changed")
    return rows.withColumn("change", change).drop("__old", "__known")


def merge(current: DataFrame, incoming: DataFrame, key: list[str], hash_col: str, fields: list[str], now: Column) -> DataFrame:
    """The snapshot after an upsert. ``current`` has key, fields, hash, first_seen_at, last_seen_at and closed_at;
    ``incoming`` has key, fields and hash. Seen rows are reopened; fields change only if the hash does."""
    new = incoming.select(*key, *[F.col(c).alias(f"__{c}") for c in [*fields, hash_col]], F.lit(True).alias("__in"))
    rows = current.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    seen, known = F.coalesce("__in", F.lit(False)), F.coalesce("__old", F.lit(False))
    changed = seen & (~known | ~F.col(hash_col).eqNullSafe(F.col(f"__{hash_col}")))
    value = [F.when(changed, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in [*fields, hash_col]]
    times = [F.when(known, F.col("first_seen_at")).otherwise(now).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(seen, None).otherwise(F.col("closed_at")).alias("closed_at")]
    return rows.select(*key, *value, *times, changed.alias("changed"), (seen & ~known).alias("is_new"))


def close_missing(current: DataFrame, live: DataFrame, board: str, external: str, now: Column) -> DataFrame:
    """``current`` with open rows closed that their board no longer lists. Boards that list nothing close nothing."""
    listed = live.select(board, external).distinct().withColumn("__live", F.lit(True))
    boards = live.select(board).distinct().withColumn("__any", F.lit(True))
    rows = current.join(listed, [board, external], "left").join(boards, board, "left")
    gone = F.col("closed_at").isNull() & F.col("__live").isNull() & F.col("__any").isNotNull()
    rows = rows.withColumn("closed_now", gone)
    return rows.withColumn("closed_at", F.when(F.col("closed_now"), now).otherwise(F.col("closed_at"))).drop("__live", "__any")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def unchanged_streak(rows: DataFrame, key: list[str], order: list[str], changed: Column) -> DataFrame:
    """``streak``: how many rows in a row, up to this one, brought no change."""
    window = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("__changed", changed).withColumn("__island", F.sum(F.col("__changed").cast("int")).over(window))
    within = Window.partitionBy(*key, "__island").orderBy(*order)
    streak = F.sum(F.when(F.col("__changed"), 0).otherwise(1)).over(within)
    return rows.withColumn("streak", streak).drop("__changed", "__island")


def hard_delete(rows: DataFrame, doomed: DataFrame, key: str, referring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without the doomed ones, and ``referring`` with its ``key`` emptied where it names no row that is left."""
    kept = rows.join(doomed.select(key).distinct(), key, "left_anti")
    left = kept.select(F.col(key).alias("__key")).distinct()
    emptied = referring.join(left, F.col(key) == F.col("__key"), "left").withColumn(key, F.col("__key")).drop("__key")
    return kept, emptied


def _last(column: str, order: list[str]) -> Column:
    """The last value that isn't null; it combines before the shuffle."""
    return F.max(F.when(F.col(column).isNotNull(), F.struct(*order, column)))[column]


def upsert_companies(companies: DataFrame, incoming: DataFrame, slug: str, name: str, optional: list[str], order: list[str]) -> DataFrame:
    """``companies`` (slug, name and the optional columns) after each row of ``incoming`` in ``order``, nulls first, was put in.

    The name is always replaced, an optional column only by a value that isn't null. A slug that is new is a new company.
    Rows of ``incoming`` with a null slug are left out, and a null name replaces nothing. ``companies`` has a row for each slug.
    """
    new = incoming.where(F.col(slug).isNotNull()).groupBy(slug).agg(*[_last(c, order).alias(f"__{c}") for c in [name, *optional]], F.lit(True).alias("__in"))
    rows = companies.select(slug, name, *optional).withColumn("__old", F.lit(True)).join(new, slug, "full_outer")
    return rows.select(slug, *[F.coalesce(f"__{c}", c).alias(c) for c in [name, *optional]], F.col("__old").isNull().alias("is_new"))


def register_boards(boards: DataFrame, incoming: DataFrame, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """``boards`` (key, fields, enabled) after registrations: one that is known is enabled again and keeps its fields, a new one
    takes them from its first registration in ``order``, nulls first. Rows of ``incoming`` with a null in the key are left out; ``boards`` has a row for
    each key."""
    new = incoming.dropna(subset=key).groupBy(*key).agg(F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in fields])).alias("__first"))
    rows = boards.select(*key, *fields, "enabled", F.lit(True).alias("__old")).join(new, key, "full_outer")
    known = F.col("__old").isNotNull()
    return rows.select(*key, *[F.when(known, F.col(c)).otherwise(F.col(f"__first.__{c}")).alias(c) for c in fields], (F.col("__first").isNotNull() | F.coalesce("enabled", F.lit(False))).alias("enabled"), (~known).alias("is_new"))
