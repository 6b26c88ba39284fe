"""Faceted search over foods, recipes and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.functions.nutrition import score_band


def search_foods(foods: DataFrame, query: str = "", grades: list[str] | None = None, max_kcal: float = 1000, min_score: int = 0, category: str | None = None) -> DataFrame:
    """Foods by text, grade list, energy cap (1000 means none), least score and category."""
    q = query.lower()
    rows = foods
    if q:
        rows = rows.where(F.lower("name").contains(q) | F.lower("category").contains(q))
    if grades:
        rows = rows.where((F.col("nutri_grade") != "") & F.upper("nutri_grade").isin(grades))
    if max_kcal < 1000:
        rows = rows.where(F.coalesce("kcal", F.lit(0.0)) <= max_kcal)
    if min_score > 0:
        rows = rows.where(F.col("health_score") >= min_score)
    if category:
        rows = rows.where(F.col("category") == category)
    return rows


def favourites(rows: DataFrame, favourite_ids: DataFrame) -> DataFrame:
    return rows.join(favourite_ids.select("id").distinct(), "id", "left_semi")


def universal_search(foods: DataFrame, recipes: DataFrame, scans: DataFrame, query: str) -> DataFrame:
    """One card shape for foods, recipes and scans: kind, id, title, score, band."""
    q = query.lower()
    card = lambda kind, title, score: [F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), title.alias("title"), score.cast("int").alias("score"), score_band(score).alias("band")]
    food = search_foods(foods, q).select(*card("food", F.col("name"), F.col("health_score")))
    recipe = recipes.where(F.lower("name").contains(q)).select(*card("recipe", F.col("name"), F.col("health_score")))
    title = F.coalesce(F.nullif(F.col("recipe_name"), F.lit("")), F.col("date").cast("string"))
    scan = scans.withColumn("title", title).where(F.lower("title").contains(q)).select(*card("scan", F.col("title"), F.col("average_score")))
    return food.unionByName(recipe).unionByName(scan)


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in a shuffle that a seed fixes."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def compare(pairs: DataFrame, columns: list[str], higher_is_better: set[str]) -> DataFrame:
    """Long rows (pair key columns, nutrient, a, b, a_pct, b_pct, better) for a_<c> and b_<c> columns."""
    rest = [c for c in pairs.columns if not c.startswith(("a_", "b_"))]
    entries = F.array(*(F.struct(F.lit(c).alias("nutrient"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b"), F.lit(c in higher_is_better).alias("up")) for c in columns))
    long = pairs.select(*rest, F.explode(entries).alias("e")).select(*rest, "e.*")
    most = F.greatest("a", "b", F.lit(1.0))
    better = F.when(F.col("a") == F.col("b"), "same").when((F.col("a") > F.col("b")) == F.col("up"), "a").otherwise("b")
    return long.select(*rest, "nutrient", "a", "b", (F.col("a") / most * 100).alias("a_pct"), (F.col("b") / most * 100).alias("b_pct"), better.alias("better"))
