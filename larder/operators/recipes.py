"""Recipes: nutrient roll-ups, scores, diets, feeds, search and shopping lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.functions.nutrition import MACROS, half_up


NULL_PARTS = 1024


def _with_food(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``right`` by food_id = ``key``; rows without a food match nothing and are dealt over NULL_PARTS keys."""
    part = F.pmod(F.xxhash64("recipe_id", "sort_order"), F.lit(NULL_PARTS)).cast("string")
    dealt = rows.withColumn("_key", F.coalesce(F.col("food_id"), F.concat(F.lit("without a food "), part)))
    return dealt.join(right, (F.col("_key") == F.col(key)) & F.col("food_id").isNotNull(), "left").drop("_key")


def linked_ingredients(ingredients: DataFrame, foods: DataFrame) -> DataFrame:
    """Ingredients with their food's columns under ``f_``; null where unlinked."""
    renamed = foods.select(*(F.col(c).alias(f"f_{c}") for c in foods.columns))
    return _with_food(ingredients, renamed, "f_id")


def _swapped(ingredients: DataFrame, swaps: DataFrame) -> DataFrame:
    """Ingredients with each food replaced by its swap, if it has one."""
    chosen = last_swaps(swaps).withColumnRenamed("food_id", "_from")
    return _with_food(ingredients, chosen, "_from").withColumn("food_id", F.coalesce("swap_id", "food_id")).drop("swap_id", "_from")


def recipe_totals(recipes: DataFrame, linked: DataFrame) -> DataFrame:
    """Per-serving macros and the energy-weighted health score of each recipe."""
    factor = F.col("grams") / 100
    kcal = F.coalesce("f_kcal", F.lit(0.0)) * factor
    sums = [F.sum(F.coalesce(F.col(f"f_{m}"), F.lit(0.0)) * factor).alias(m) for m in MACROS]
    weighted = [F.sum(F.when(kcal > 0, F.col("f_health_score") * kcal)).alias("score_kcal"), F.sum(F.when(kcal > 0, kcal)).alias("linked_kcal")]
    per_recipe = linked.where("f_id is not null").groupBy("recipe_id").agg(*sums, *weighted)
    serves = F.coalesce(F.nullif(F.col("serves"), F.lit(0)), F.lit(1))
    rows = recipes.join(per_recipe, recipes["id"] == per_recipe["recipe_id"], "left")
    score = F.coalesce(half_up(F.try_divide("score_kcal", "linked_kcal")), F.lit(50)).cast("int")
    return rows.select("id", *((F.coalesce(F.col(m), F.lit(0.0)) / serves).alias(m) for m in MACROS), score.alias("health_score"))


def last_swaps(swaps: DataFrame) -> DataFrame:
    """food_id, swap_id: of several choices for one food the later (column seq, if there is one)."""
    order = "seq" if "seq" in swaps.columns else "swap_id"
    return swaps.groupBy("food_id").agg(F.max_by("swap_id", order).alias("swap_id"))


def recipe_totals_with_swaps(recipes: DataFrame, ingredients: DataFrame, foods: DataFrame, swaps: DataFrame) -> DataFrame:
    """As :func:`recipe_totals` with each food replaced by its swap (food_id, swap_id)."""
    return recipe_totals(recipes, linked_ingredients(_swapped(ingredients, swaps), foods))


def diet_recipes(recipes: DataFrame, linked: DataFrame, diets: list[str]) -> DataFrame:
    """Recipes without an ingredient that the diets exclude."""
    bad = F.lit(False)
    if "Vegetarian" in diets or "Vegan" in diets:
        bad = bad | F.col("f_category").isin("Meat", "Fish")
    if "Vegan" in diets:
        bad = bad | (F.col("f_category") == "Dairy") | F.lower("f_swiss_category").contains("egg")
    offending = linked.where(bad).select(F.col("recipe_id").alias("id")).distinct()
    return recipes.join(offending, "id", "left_anti")


def feed(recipes: DataFrame, linked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Recipes with the number of ingredients whose food is relevant (column food_id)."""
    hits = linked.join(relevant.select("food_id").distinct(), "food_id", "left_semi").groupBy("recipe_id").agg(F.count(F.lit(1)).alias("relevance"))
    return recipes.join(hits, recipes["id"] == hits["recipe_id"], "left").drop("recipe_id").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def search_recipes(recipes: DataFrame, linked: DataFrame, query: str) -> DataFrame:
    """Recipes whose name, an ingredient's text or food name contains the query.

    Texts and food names are searched apart: the first needs no foods, and of these only those found are joined.
    """
    q = query.lower()
    found = lambda rows: rows.select(F.col("recipe_id").alias("id")).distinct()
    named_food = F.lower("f_name").contains(q) if q else F.lit(True)
    child = found(linked.where(F.lower("raw_text").contains(q))).unionByName(found(linked.where(named_food)))
    named = recipes.where(F.lower("name").contains(q)).select("id")
    return recipes.join(named.unionByName(child).distinct(), "id", "left_semi")


def with_children(recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Recipes with their ingredients as an ordered array."""
    child = F.array_sort(F.collect_list(F.struct("sort_order", "food_id", "raw_text", "grams")))
    attached = ingredients.groupBy("recipe_id").agg(child.alias("ingredients"))
    return recipes.join(attached, recipes["id"] == attached["recipe_id"], "left").drop("recipe_id")


def shopping_list(recipes: DataFrame, ingredients: DataFrame, servings: int, swaps: DataFrame | None = None) -> DataFrame:
    """Items of a list for ``servings`` of each recipe, foods swapped if swaps are given."""
    rows = ingredients.join(recipes.select(F.col("id").alias("recipe_id"), F.col("name").alias("recipe_name"), "serves"), "recipe_id")
    if swaps is not None:
        rows = _swapped(rows, swaps)
    scale = F.lit(float(servings)) / F.coalesce(F.nullif(F.col("serves"), F.lit(0)), F.lit(1))
    quantity = F.when(F.col("grams") > 0, F.col("grams") * scale)
    return rows.select("recipe_id", "sort_order", "food_id", "raw_text", "recipe_name", F.lit(1.0).alias("confidence"), F.lit("recipe").alias("source"), quantity.alias("quantity"), F.when(quantity.isNotNull(), "g").alias("unit"))
