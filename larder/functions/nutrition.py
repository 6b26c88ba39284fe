"""Nutrition arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions import words as W

MACROS = ["kcal", "protein_g", "carbs_g", "sugars_g", "fat_g", "saturated_fat_g", "fiber_g", "salt_g"]


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def percent_of_target(value: Column, target: Column) -> Column:
    """Share of a target in whole percent, at most 100; 0 for a target of 0."""
    return F.coalesce(F.least(F.lit(100), half_up(F.try_divide(value, target) * 100)), F.lit(0)).cast("int")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 65, "good").when(score >= 50, "fair").otherwise("poor")


def confidence_bucket(confidence: Column, food_id: Column) -> Column:
    """not_found below 0.45 or without a food, confident above 0.72, else potential; no confidence counts as 1."""
    c = F.coalesce(confidence, F.lit(1.0))
    return F.when(food_id.isNull() | (c < 0.45), "not_found").when(c > 0.72, "confident").otherwise("potential")


def category_icon(category: Column) -> Column:
    out = None
    for icon, parts in W.ICONS:
        hit = F.lower(category).rlike("|".join(parts))
        out = F.when(hit, icon) if out is None else out.when(hit, icon)
    return out.otherwise("fast-food-outline")


def micro_name(key: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(key, "_(mg|ug)$", ""), "_", " "))


def micro_unit(key: Column) -> Column:
    return F.when(key.endswith("_mg"), "mg").when(key.endswith("_ug"), "µg")


def number_text(value: Column) -> Column:
    """Whole numbers without decimals, others with one."""
    return F.when(value % 1 == 0, value.cast("long").cast("string")).when(value.isNotNull(), F.format_string("%.1f", value))


def time_and_difficulty(steps: Column, linked: Column) -> tuple[Column, Column]:
    minutes = 10 + F.size(steps) * 5 + linked * 2
    hours = half_up(minutes / 60 * 10) / 10
    text = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(number_text(hours), F.lit(" hr")))
    length = F.length(F.array_join(steps, ""))
    return text, F.when((linked >= 7) | (length > 600), "Medium").otherwise("Easy")


def site_name(url: Column) -> Column:
    """The known name of a url's site, else its first host label with a capital; a default without a host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]+)", 1)), r"^www\.", "")
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in W.SITES.items() for x in pair)), host)
    label = F.substring_index(host, ".", 1)
    plain = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label)))
    return F.coalesce(known, F.when(host != "", plain), F.lit("Original Recipe"))


def energy_target(sex: Column, age: Column, weight: Column, height: Column, activity: Column, goal: Column) -> Column:
    """Daily kilocalories: basal rate by activity plus the goal's offset."""
    basal = weight * 10 + height * 6.25 - age * 5 + F.when(sex == "Male", 5).otherwise(-161)
    factor = F.create_map(*(F.lit(x) for pair in W.ACTIVITY.items() for x in pair))
    offset = F.create_map(*(F.lit(x) for pair in W.GOAL_KCAL.items() for x in pair))
    return half_up(basal * F.try_element_at(factor, activity) + F.try_element_at(offset, goal)).cast("int")


def macro_targets(kcal: Column, diets: Column) -> dict[str, Column]:
    """Grams of each macronutrient for a day."""
    has = lambda x: F.array_contains(diets, x)
    plant = has("Vegetarian") | has("Vegan")
    protein = F.when(has("High Protein"), 0.35).when(has("Low Carb"), 0.30).when(plant, 0.20).otherwise(0.25)
    carbs = F.when(has("High Protein"), 0.35).when(has("Low Carb"), 0.20).when(plant, 0.50).otherwise(0.45)
    fat = F.when(has("High Protein"), 0.30).when(has("Low Carb"), 0.50).otherwise(0.30)
    grams = {"protein_g": kcal * protein / 4, "carbs_g": kcal * carbs / 4, "fat_g": kcal * fat / 9, "sugars_g": kcal * 0.1 / 4, "saturated_fat_g": kcal * 0.1 / 9, "fiber_g": kcal / 1000 * 14}
    return {k: half_up(v).cast("int") for k, v in grams.items()} | {"salt_g": F.lit(6)}
