"""Feedback state: preferences, overrides and document-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LOW, HIGH, RATE = 0.3, 1.8, 0.15
CATEGORY_SHARE, FOOD_SHARE = 0.3, 0.5


def preference_fold(events: DataFrame, keys: list[str], share: float, chunk: int = 10_000) -> DataFrame:
    """keys, multiplier, n_events after all events (order column seq, accepted boolean).

    Each event moves the multiplier by a constant share towards its target, so
    the fold has a closed form: a weighted sum over the events by their rank from
    the end.  It starts at 1 and never leaves [0.3, 1.8].  A key's events are
    ranked in stretches of ``chunk`` values of seq, and only the stretches' sums
    meet in one task: a weight within a stretch times one for the events after it.
    """
    a = RATE * share
    stretch = F.floor(F.col("seq") / chunk).alias("_stretch")
    rows = events.select(*keys, stretch, "seq", F.when(F.col("accepted"), HIGH).otherwise(LOW).alias("_target"))
    after = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(F.desc("seq"))) - 1
    parts = rows.withColumn("_part", F.col("_target") * a * F.pow(F.lit(1 - a), after)).groupBy(*keys, "_stretch").agg(F.sum("_part").alias("_part"), F.count(F.lit(1)).alias("_n"))
    later = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    folded = parts.withColumn("_sum", F.col("_part") * F.pow(F.lit(1 - a), later)).groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("n_events"))
    return folded.select(*keys, (F.pow(F.lit(1 - a), F.col("n_events")) + F.col("_sum")).alias("multiplier"), "n_events")


def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each non-empty key: the last written."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return kept.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, "_v.*")


def update_by_key(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` with those of ``changes`` in place of equal keys; new keys are ignored."""
    known = changes.join(table.select(key), key, "left_semi")
    return table.join(changes.select(key), key, "left_anti").unionByName(known)


def delete_by_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def toggle(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Membership flipped for each changed row."""
    return table.join(changes, keys, "left_anti").select(*keys).unionByName(changes.join(table, keys, "left_anti").select(*keys))
