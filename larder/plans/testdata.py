"""Adapters: the driver tables seen as catalog, recipes, ingredients, lines, scans and profiles.

Each adapter is one SQL text that Spark and DuckDB both run, so that queries and
their counterparts start from the same rows.  ``{part}`` and the like stand for
the driver tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larder.functions.words import MICRO_TARGETS

#: word, German name, category, swiss category
FOODS = [
    ("whole milk 3.5%", "Vollmilch 3,5 % Fett", "Dairy", "Milk and dairy products/Milk"),
    ("natural yoghurt", "Joghurt nature", "Dairy", "Milk and dairy products/Yoghurt"),
    ("fruit yoghurt sweetened", None, "Dairy", "Milk and dairy products/Yoghurt"),
    ("gouda cheese", "Gouda Käse", "Dairy", "Milk and dairy products/Cheese"),
    ("whipping cream", "Schlagsahne", "Dairy", "Milk and dairy products/Cream"),
    ("soy drink plain", "Sojadrink pflanzlich", "Drinks", "Milk and dairy alternatives/Soy"),
    ("olive oil", "Olivenöl", "Fats", "Fats and oils/Oils"),
    ("butter", "Butter", "Fats", "Fats and oils/Butter"),
    ("boiled potato", "Kartoffel gekocht", "Vegetables", "Potatoes and starches/Potatoes"),
    ("beef mince", "Rindfleisch gehackt", "Meat", "Meat and offal/Beef"),
    ("pork sausage", "Bratwurst", "Meat", "Meat products/Sausages"),
    ("steak", "Steak", "Meat", "Meat and offal/Beef"),
    ("chicken breast", "Hähnchenbrust", "Meat", "Poultry/Chicken"),
    ("salmon fish", "Lachs", "Fish", "Fish/Sea fish"),
    ("white bread", "Weissbrot", "Grains", "Bread and cereals/Bread"),
    ("whole grain bread", "Vollkornbrot", "Grains", "Bread and cereals/Bread"),
    ("pasta", "Teigwaren", "Grains", "Bread and cereals/Pasta"),
    ("bread crumb", "Paniermehl", "Grains", "Bread and cereals/Crumbs"),
    ("wheat flour", "Weizenmehl", "Grains", "Bread and cereals/Flour"),
    ("corn starch", None, "Grains", "Bread and cereals/Flour"),
    ("tomato raw", "Tomate roh", "Vegetables", "Vegetables/Fresh vegetables"),
    ("dried tomato", "Tomate getrocknet", "Vegetables", "Vegetables/Dried vegetables"),
    ("mixed vegetable", "Mischgemüse", "Vegetables", "Vegetables/Frozen vegetables"),
    ("apple", "Apfel", "Fruit", "Fruit/Fresh fruit"),
    ("apple juice", "Apfelsaft", "Drinks", "Beverages/Juice"),
    ("banana", "Banane", "Fruit", "Fruit/Fresh fruit"),
    ("chocolate", "Schokolade", "Sweets", "Sweets/Chocolate"),
    ("honey", "Honig", "Sweets", "Sweets/Sugar"),
    ("sugar", "Zucker", "Sweets", "Sweets/Sugar"),
    ("candy zero", None, "Sweets", "Sweets/Candy"),
    ("cola", "Cola", "Drinks", "Beverages/Soft drinks"),
    ("cola zero", "Cola zero", "Drinks", "Beverages/Soft drinks"),
    ("energy drink", "Energydrink", "Drinks", "Beverages/Soft drinks"),
    ("beer", "Bier", "Drinks", "Beverages/Alcohol"),
    ("black tea", "Schwarztee", "Drinks", "Beverages/Tea"),
    ("decaf coffee", "Kaffee koffeinfrei", "Drinks", "Beverages/Coffee"),
    ("coffee", "Kaffee", "Drinks", "Beverages/Coffee"),
    ("egg", "Hühnerei", "Eggs", "Eggs/Chicken egg"),
    ("baking powder", "Backpulver", "Baking", "Baking/Leavening"),
    ("dry yeast", "Trockenhefe", "Baking", "Baking/Yeast"),
    ("salt", "Salz", "Seasonings", "Seasonings and condiments/Salt"),
    ("black pepper", "Pfeffer schwarz", "Seasonings", "Seasonings and condiments/Spices"),
    ("peanut", "Erdnuss", "Nuts", "Nuts and seeds/Nuts"),
]


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else f"'{value}'"


def values(rows: list[tuple], columns: str, alias: str = "v") -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS {alias}({columns})"


def _every(n: int, expr: str) -> str:
    return f"CASE WHEN p.p_partkey % {n} = 0 THEN NULL ELSE {expr} END"


def _tenths(a: int, b: int) -> str:
    return f"CAST((p.p_partkey * {a}) % {b} AS DOUBLE) / 10"


CATALOG = f"""
SELECT CAST(p.p_partkey AS STRING) AS id, p.p_partkey AS row_ord, p.p_name || ' ' || w.word AS name,
       CASE WHEN w.name_de IS NULL THEN NULL ELSE w.name_de || ' ' || p.p_name END AS name_de, w.category, w.swiss AS swiss_category,
       CAST((p.p_partkey * 37) % 101 AS INT) AS health_score, substr('ABCDE', CAST(p.p_partkey % 5 + 1 AS INT), 1) AS nutri_grade,
       CAST({_every(7, 'p.p_partkey % 4 + 1')} AS INT) AS nova_group,
       {_every(13, 'CAST((p.p_partkey * 7) % 600 AS DOUBLE)')} AS kcal, {_tenths(11, 300)} AS protein_g, {_every(19, _tenths(13, 700))} AS carbs_g,
       {_tenths(17, 400)} AS sugars_g, {_tenths(19, 500)} AS fat_g, {_tenths(23, 200)} AS saturated_fat_g, {_tenths(29, 120)} AS fiber_g,
       {_every(17, _tenths(31, 50))} AS salt_g, {_every(11, 'CAST((p.p_partkey * 41) % 900 AS DOUBLE)')} AS calcium_mg, {_tenths(43, 80)} AS iron_mg
FROM {{part}} p JOIN {values([(k, *f) for k, f in enumerate(FOODS)], 'k, word, name_de, category, swiss', 'w')} ON p.p_partkey % {len(FOODS)} = w.k
"""

RECIPES = """
SELECT CAST(o_orderkey AS STRING) AS id, 'Recipe ' || o_orderpriority || ' ' || CAST(o_orderkey AS STRING) AS name,
       CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 + o_orderkey % 6 END AS INT) AS serves,
       CASE o_orderstatus WHEN 'O' THEN 'Main dish' WHEN 'F' THEN 'Dessert' ELSE 'Side dish' END AS subcategory
FROM {orders}
"""

INGREDIENTS = """
SELECT CAST(l_orderkey AS STRING) AS recipe_id, CAST(l_linenumber AS INT) AS sort_order,
       CASE WHEN l_linenumber = 7 OR l_partkey % 23 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS food_id,
       CAST(CAST(l_quantity AS INT) AS STRING) || CASE l_partkey % 12 WHEN 0 THEN 'g spinach' WHEN 1 THEN ' tbsp oil' WHEN 2 THEN ' eggs' WHEN 3 THEN ',5 kg flour'
         WHEN 4 THEN ' cups milk' WHEN 5 THEN ' large eggs' WHEN 6 THEN '½ onion' WHEN 7 THEN ' cloves garlic' WHEN 8 THEN ' tomatoes' WHEN 9 THEN ' l water' WHEN 10 THEN ' oz ham' ELSE 'x' END AS raw_text,
       CAST(l_quantity AS DOUBLE) * 10 AS grams
FROM {lineitem}
"""

SCAN_ITEMS = """
SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS scan_id, event_id AS seq, user_id, CAST(ts AS DATE) AS scan_date, event_type,
       CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST((event_id * 7) % 200 + 1 AS STRING) END AS food_id,
       CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, CAST(event_id % 5 AS DOUBLE) * 50 AS quantity, event_type = 'signup' AS is_shopping_list, props
FROM {events}
"""

PROFILES = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex, CAST(18 + c_custkey % 60 AS DOUBLE) AS age,
       CAST(45 + c_custkey % 70 AS DOUBLE) AS weight, CAST(150 + c_custkey % 50 AS DOUBLE) AS height,
       CASE c_custkey % 5 WHEN 0 THEN 'Sedentary' WHEN 1 THEN 'Lightly Active' WHEN 2 THEN 'Moderately Active' WHEN 3 THEN 'Very Active' ELSE 'Extra Active' END AS activity_level,
       CASE c_custkey % 5 WHEN 0 THEN '-0.5 kg' WHEN 1 THEN '-0.25 kg' WHEN 2 THEN 'stay' WHEN 3 THEN '+0.25 kg' ELSE '+0.5 kg' END AS weight_goal,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'High Protein' WHEN 'MACHINERY' THEN 'Low Carb' WHEN 'HOUSEHOLD' THEN 'Vegan' WHEN 'FURNITURE' THEN 'Vegetarian' ELSE 'Balanced' END AS diet
FROM {customer}
"""

#: Catalog names with damage: a letter dropped, a digit for a letter, prices, weights, glued counts.
NOISY_LINES = f"""
SELECT id AS line_id,
       CASE row_ord % 6 WHEN 0 THEN name WHEN 1 THEN replace(name, 'o', '0') || ' 1,99 A' WHEN 2 THEN upper(coalesce(name_de, name)) || ' 500g 2,49'
         WHEN 3 THEN substr(name, 1, CAST(length(name) - 2 AS INT)) WHEN 4 THEN '2x ' || coalesce(name_de, name) ELSE coalesce(name_de, name) || ' 0,89 B' END AS raw_text
FROM ({CATALOG})
"""

#: Micronutrients one row each: absent for a ninth of the foods, zero for some.
MICROS = f"""
SELECT id, CASE k {' '.join(f"WHEN {k} THEN '{name}'" for k, (name, _, _) in enumerate(MICRO_TARGETS))} END AS nutrient,
       CASE WHEN (p_partkey + k) % 9 = 0 THEN NULL WHEN (p_partkey * 3 + k) % 11 = 0 THEN 0 ELSE CAST((p_partkey * (2 * k + 3)) % 500 AS DOUBLE) / 10 END AS amount
FROM (SELECT CAST(p_partkey AS STRING) AS id, p_partkey, <numbers to {len(MICRO_TARGETS) - 1}> AS k FROM {{part}})
"""
_NUMBERS = re.compile(r"<numbers to (\d+)>")

_TABLES = ("supplier", "part", "orders", "lineitem", "events", "customer", "documents", "benchmark", "labels", "conversations", "pages", "embeddings")


def duck(sql: str) -> str:
    """The adapter as a subquery over DuckDB's views."""
    return "(" + _NUMBERS.sub(r"unnest(range(\1 + 1))", sql).format(**{t: t for t in _TABLES}) + ")"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The adapter as a DataFrame over the tables in ``sf_dir``."""
    used = [t for t in _TABLES if "{" + t + "}" in sql]
    return spark.sql(_NUMBERS.sub(r"explode(sequence(0, \1))", sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
