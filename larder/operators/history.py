"""Scans over time: scores, weeks, owned foods and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions.nutrition import half_up


def scan_scores(items: DataFrame, floor: float = 0.45, empty: int = 0) -> DataFrame:
    """scan_id, average_score over matched items of at least ``floor`` confidence (health_score column)."""
    counted = F.col("food_id").isNotNull() & (F.col("confidence") >= floor)
    score = F.coalesce(half_up(F.avg(F.when(counted, F.col("health_score")))), F.lit(empty)).cast("int")
    return items.groupBy("scan_id").agg(score.alias("average_score"))


def weekly_groups(scans: DataFrame) -> DataFrame:
    """Per Monday week: number of scans and rounded mean score; shopping lists are left out."""
    week = F.date_trunc("week", "date").cast("date")
    rows = scans.where(~F.coalesce("is_shopping_list", F.lit(False)))
    grouped = rows.groupBy(week.alias("week_start")).agg(F.count(F.lit(1)).alias("n_scans"), half_up(F.avg("average_score")).cast("int").alias("average_score"))
    return grouped.withColumn("week_end", F.date_add("week_start", 6))


def distinct_foods(items: DataFrame, seq: str = "seq") -> DataFrame:
    """Each food once with its last item, ordered by its first occurrence."""
    rest = [c for c in items.columns if c != "food_id"]
    return items.where("food_id is not null").groupBy("food_id").agg(F.max_by(F.struct(*rest), seq).alias("last"), F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("times"))


def owned_foods(items: DataFrame) -> DataFrame:
    return items.where("food_id is not null").select("food_id").distinct()


def last_entries(log: DataFrame, n: int, key: Column, order: str) -> DataFrame:
    """The last ``n`` rows of each key's log."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return log.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def receipt_totals(items: DataFrame, foods: DataFrame, columns: list[str]) -> DataFrame:
    """Per scan the sum of nutrients at quantity (100 g where absent or 0)."""
    factor = F.coalesce(F.nullif(F.col("quantity"), F.lit(0.0)), F.lit(100.0)) / 100
    rows = items.join(foods.select(F.col("id").alias("food_id"), *columns), "food_id")
    return rows.groupBy("scan_id").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * factor).alias(c) for c in columns))


def micro_totals(micros: DataFrame, key: str) -> DataFrame:
    """Sum of each guarded micronutrient over rows with a ``micros`` map."""
    long = micros.select(key, F.explode("micros").alias("nutrient", "amount")).where(F.col("nutrient").rlike("_(mg|ug)$") & F.col("amount").isNotNull() & ~F.isnan("amount"))
    return long.groupBy(key, "nutrient").agg(F.sum("amount").alias("amount"))
