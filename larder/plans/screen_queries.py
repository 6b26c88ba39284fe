"""Queries of the application's screens, each with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import nutrition as N, text as X, words as W
from larder.operators import history, matching, pipelines, recipes, screens as S, search, swaps
from larder.plans import matcher_queries, testdata as D
from larder.sources import loader
from larder.sources.scratch import fresh_folder
from larder.plans.catalog_queries import _BRANDS, _COSINE, _FEATURED, _KCAL, _LINKED, _MICRO_VALUES, _PAIR_SQL, FOODS, INGREDIENTS, ITEMS, LINES, PROFILES, RECIPES, _foods, _query, _r, _recipe_parts, _table, _totals_sql, oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
MICROS = D.duck(D.MICROS)
_OWNED = f"(SELECT DISTINCT food_id FROM {ITEMS} WHERE food_id IS NOT NULL)"


def _swaps_sql(sources: str, vegetarian: bool = True) -> str:
    """CTEs f, pairs and ranked for the source foods of a subquery (food_id)."""
    diet = " AND c.category NOT IN ('Meat', 'Fish')" if vegetarian else ""
    return _PAIR_SQL.replace("WHERE s.health_score < 80", f"WHERE s.id IN (SELECT food_id FROM {sources}) AND s.health_score < 80{diet}")


def _items(spark, d):
    return D.frame(spark, d, D.SCAN_ITEMS)


_VEGETARIAN = f"NOT EXISTS (SELECT 1 FROM {_LINKED} l WHERE l.recipe_id = r.id AND l.f_category IN ('Meat', 'Fish'))"


@_query(_swaps_sql(_OWNED) + f""",
relevant AS (SELECT food_id FROM {_OWNED} UNION SELECT swap_id FROM ranked WHERE rank <= 2),
hits AS (SELECT l.recipe_id, count(*) AS n FROM {_LINKED} l JOIN relevant v ON v.food_id = l.food_id GROUP BY l.recipe_id),
feed AS (SELECT r.id, coalesce(h.n, 0) AS relevance, t.health_score FROM {RECIPES} r JOIN ({_totals_sql(_LINKED)}) t ON t.id = r.id LEFT JOIN hits h ON h.recipe_id = r.id WHERE contains(lower(r.subcategory), 'dish') AND {_VEGETARIAN})
SELECT id, relevance, health_score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC, health_score DESC, CAST(id AS BIGINT)) AS place FROM feed) WHERE place <= 31""")
def recipe_feed_page(spark, d):
    """The featured recipe and three pages of ten: diets, subcategory, relevance by owned foods and their swaps, health."""
    r, i, f = _recipe_parts(spark, d)
    linked = recipes.linked_ingredients(i, f)
    found = S.recipe_feed(r, linked, recipes.recipe_totals(r, linked), S.relevant_foods(_items(spark, d), f, ["Vegetarian"]), diets=["Vegetarian"], category="Dish", limit=31)
    return found.select("id", "relevance", "health_score", F.col("place").cast("int").alias("place"))


@_query(f"""
SELECT r.id, t.kcal, t.health_score FROM {RECIPES} r JOIN ({_totals_sql(_LINKED)}) t ON t.id = r.id
WHERE (contains(lower(r.name), 'ham') OR EXISTS (SELECT 1 FROM {_LINKED} l WHERE l.recipe_id = r.id AND (contains(lower(l.raw_text), 'ham') OR contains(lower(coalesce(l.f_name, '')), 'ham'))))
  AND {_VEGETARIAN} AND contains(lower(r.subcategory), 'd') AND t.kcal <= 1400 AND t.health_score >= 30 AND CAST(r.id AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)""")
def recipe_search_filters(spark, d):
    """Recipes by text, diet, subcategory, energy of a serving, least score and favourites."""
    r, i, f = _recipe_parts(spark, d)
    linked = recipes.linked_ingredients(i, f)
    liked = r.where("cast(id as bigint) % 3 <> 0").select("id")
    found = S.recipe_results(r, linked, recipes.recipe_totals(r, linked), recipes.search_recipes(r, linked, "Ham"), diets=["Vegetarian"], category="D", max_kcal=1400, min_score=30, favourites=liked)
    return found.select("id", _r("kcal").alias("kcal"), "health_score")


_DISCOVERED = " SELECT r.food_id || '-' || r.swap_id AS swap_key, r.food_id, r.swap_id, t.health_score - s.health_score AS improvement FROM ranked r JOIN f s ON s.id = r.food_id JOIN f t ON t.id = r.swap_id WHERE r.rank = 1"


@_query(_swaps_sql(f"(SELECT id AS food_id FROM {FOODS} WHERE contains(lower(name), 'milk') OR contains(lower(category), 'milk') ORDER BY row_ord LIMIT 10)") + _DISCOVERED)
def swap_discovery(spark, d):
    """The best swaps of the first ten foods that a text finds."""
    foods = _foods(spark, d)
    return S.discovered_swaps(foods, search.search_foods(foods, "Milk").orderBy("row_ord").limit(10), ["Vegetarian"])


@_query(_swaps_sql(f"(SELECT id AS food_id FROM {FOODS} WHERE health_score < 50 ORDER BY md5(id || ':7') LIMIT 20)", False) + _DISCOVERED)
def swap_discovery_sample(spark, d):
    """The best swaps of twenty foods of low score, drawn by a seeded shuffle."""
    foods = _foods(spark, d)
    drawn = foods.where("health_score < 50").orderBy(S.seeded_place(F.col("id"), 7)).limit(20)
    return S.discovered_swaps(foods, drawn, [])


@_query(_swaps_sql(_OWNED) + f""",
bought AS (SELECT food_id, min(seq) AS first_seq FROM {ITEMS} WHERE food_id IS NOT NULL GROUP BY food_id),
swapped AS (SELECT id, first_seq, rank FROM (SELECT r.swap_id AS id, b.first_seq, r.rank, row_number() OVER (PARTITION BY r.swap_id ORDER BY b.first_seq, r.rank) AS k FROM ranked r JOIN bought b ON b.food_id = r.food_id WHERE r.rank <= 2) WHERE k = 1),
chosen AS (SELECT id, 0 AS turn, first_seq, rank, '' AS mixed FROM swapped ORDER BY first_seq, rank LIMIT 5),
spare AS (SELECT id, 1 AS turn, 0 AS first_seq, 0 AS rank, md5(id || ':42') AS mixed FROM {FOODS} WHERE health_score >= 60 AND id NOT IN (SELECT id FROM chosen) ORDER BY mixed LIMIT 5),
five AS (SELECT id, row_number() OVER (ORDER BY turn, first_seq, rank, mixed) AS p FROM (SELECT * FROM chosen UNION ALL SELECT * FROM spare) ORDER BY p LIMIT 5)
SELECT CAST(CASE WHEN p = 1 THEN c WHEN p - 1 < c THEN p - 1 ELSE p END AS INT) AS place, id, p = 1 AS spotlight FROM (SELECT *, (count(*) OVER () - 1) // 2 + 1 AS c FROM five)""")
def home_carousel(spark, d):
    return S.carousel(_items(spark, d), _foods(spark, d), ["Vegetarian"])


@_query(_swaps_sql(f"(SELECT food_id FROM {ITEMS} WHERE food_id IS NOT NULL AND confidence > 0.72)", False) + f""",
best AS (SELECT r.food_id, t.health_score - s.health_score AS improvement FROM ranked r JOIN f s ON s.id = r.food_id JOIN f t ON t.id = r.swap_id WHERE r.rank = 1)
SELECT i.scan_id, CAST(coalesce(floor(avg(g.health_score) FILTER (WHERE i.confidence >= 0.45) + 0.5), 0) AS INT) AS average_score, count(*) AS n_items,
       count(*) FILTER (WHERE i.food_id IS NULL OR i.confidence < 0.72) AS n_weak, count(*) FILTER (WHERE i.confidence > 0.72 AND b.improvement IS NOT NULL) AS n_swaps,
       CAST(coalesce(sum(b.improvement) FILTER (WHERE i.confidence > 0.72), 0) AS BIGINT) AS improvement
FROM {ITEMS} i LEFT JOIN {FOODS} g ON g.id = i.food_id LEFT JOIN best b ON b.food_id = i.food_id GROUP BY i.scan_id""")
def scan_pipeline(spark, d):
    """Resolved items of each scan to its score, weak lines and swaps."""
    return S.scan_summary(_items(spark, d), _foods(spark, d), [])


@_query(_swaps_sql(_OWNED, False) + f", left_over AS (SELECT *, row_number() OVER (PARTITION BY food_id ORDER BY rank) AS k FROM ranked WHERE rank <= 9 AND swap_id NOT IN (SELECT food_id FROM {ITEMS} WHERE event_type = 'error' AND food_id IS NOT NULL)) SELECT food_id, swap_id, CAST(k AS INT) AS rank FROM left_over WHERE k <= 3")
def swaps_without_dismissed(spark, d):
    """The three best of nine swaps that the user has not dismissed."""
    items = _items(spark, d)
    pool = swaps.top_swaps(_foods(spark, d), 9, [], sources=items.where("food_id is not null").select("food_id"))
    gone = items.where("event_type = 'error' and food_id is not null").select(F.col("food_id").alias("swap_id"))
    left = history.last_entries(S.without(pool, gone, "swap_id").withColumn("turn", -F.col("rank")), 3, F.col("food_id"), "turn")
    place = F.row_number().over(history.Window.partitionBy("food_id").orderBy("rank"))
    return left.select("food_id", "swap_id", place.cast("int").alias("place")).withColumnRenamed("place", "rank")


@_query(f"SELECT user_id, seq, food_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM {ITEMS} WHERE food_id IS NULL OR confidence < 0.72) WHERE k <= 500")
def weak_match_log(spark, d):
    """The last 500 weak matches of each user."""
    return history.last_entries(S.weak_matches(_items(spark, d)), S.MATCH_LOG_ROWS, F.col("user_id"), "seq").select("user_id", "seq", "food_id", "confidence")


@_query(f"SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE food_id IS NULL OR confidence < 0.72) AS n_weak, count(DISTINCT scan_id) AS n_scans, count(DISTINCT scan_id) FILTER (WHERE is_shopping_list) AS n_lists FROM {ITEMS} GROUP BY user_id")
def log_counts(spark, d):
    weak = F.col("food_id").isNull() | (F.col("confidence") < S.WEAK_BELOW)
    return _items(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(weak).alias("n_weak"), F.count_distinct("scan_id").alias("n_scans"), F.count_distinct(F.when(F.col("is_shopping_list"), F.col("scan_id"))).alias("n_lists"))


_DECIDED = f"(SELECT DISTINCT food_id FROM {ITEMS} WHERE food_id IS NOT NULL AND event_type IN ('purchase', 'error'))"


@_query(_swaps_sql(_DECIDED, False) + f"""
SELECT i.seq, r.swap_id, round({_COSINE}, 6) AS cosine_sim, CAST(s.swiss_category = c.swiss_category AS DOUBLE) AS same_swiss_category, CAST(s.liquid <> c.liquid AS DOUBLE) AS liquid_mismatch, CAST(s.raw <> c.raw AS DOUBLE) AS raw_ingredient_mismatch,
       round(c.kcal - s.kcal, 4) AS delta_kcal, round(c.sugars_g - s.sugars_g, 4) AS delta_sugar_g, round(c.fat_g - s.fat_g, 4) AS delta_fat_g, round(c.saturated_fat_g - s.saturated_fat_g, 4) AS delta_satfat_g, round(c.protein_g - s.protein_g, 4) AS delta_protein_g,
       CASE WHEN i.event_type = 'purchase' THEN 'GOOD' ELSE 'BAD' END AS label, CAST(i.event_type = 'purchase' AS INT) AS is_good
FROM {ITEMS} i JOIN ranked r ON r.food_id = i.food_id AND r.rank = 1 JOIN f s ON s.id = r.food_id JOIN f c ON c.id = r.swap_id WHERE i.event_type IN ('purchase', 'error')""")
def decision_log(spark, d):
    """A training row with all nine features for each decision on the swap that was shown, the best of the food."""
    foods = _foods(spark, d)
    events = _items(spark, d).where(F.col("event_type").isin("purchase", "error") & F.col("food_id").isNotNull()).select("seq", "food_id", "event_type")
    shown = swaps.top_swaps(foods, 1, sources=events).select("food_id", "swap_id")
    good = F.col("event_type") == "purchase"
    rows = S.decision_rows(events.join(shown, "food_id"), foods)
    return rows.select("seq", "swap_id", *((_r(c, 6) if c == "cosine_sim" else _r(c)).alias(c) for c in swaps.FEATURES), F.when(good, "GOOD").otherwise("BAD").alias("label"), good.cast("int").alias("is_good"))


@_query(f"SELECT user_id, count(*) AS n_events FROM {ITEMS} WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, arg_min(event_type, seq) AS first_type FROM {ITEMS} GROUP BY user_id) WHERE first_type = 'signup') GROUP BY user_id")
def pref_reset(spark, d):
    """What is left of the feedback once users whose first entry is a signup have reset theirs."""
    items = _items(spark, d)
    anew = items.groupBy("user_id").agg(F.min_by("event_type", "seq").alias("first_type")).where("first_type = 'signup'")
    return S.reset(items, anew, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))


# Micronutrients
@_query(f"""SELECT f.id, m.nutrient, array_to_string(list_transform(string_split(regexp_replace(m.nutrient, '_(mg|ug)$', ''), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
  CASE WHEN ends_with(m.nutrient, '_mg') THEN 'mg' ELSE 'µg' END AS unit, m.amount, CAST(least(100, floor(m.amount / CASE WHEN CAST(f.id AS BIGINT) % 2 = 0 THEN t.male ELSE t.female END * 100 + 0.5)) AS INT) AS percent
FROM {FOODS} f JOIN {MICROS} m ON m.id = f.id LEFT JOIN {_MICRO_VALUES.replace(' AS v(', ' AS t(')} ON t.nutrient = m.nutrient WHERE m.amount > 0""")
def nonzero_micros(spark, d):
    """The micronutrients that a food has, with their names and shares of the reader's target by sex."""
    micros = D.frame(spark, d, D.MICROS).where("amount > 0")
    targets = spark.sql(f"SELECT * FROM {_MICRO_VALUES}")
    target = F.when(F.col("id").cast("long") % 2 == 0, F.col("male")).otherwise(F.col("female"))
    return micros.join(F.broadcast(targets), "nutrient", "left").select("id", "nutrient", N.micro_name(F.col("nutrient")).alias("label"), N.micro_unit(F.col("nutrient")).alias("unit"), "amount", N.percent_of_target(F.col("amount"), target).alias("percent"))


@_query(f"SELECT i.recipe_id, m.nutrient, round(sum(coalesce(m.amount, 0) * i.grams / 100) / any_value(coalesce(nullif(r.serves, 0), 1)), 4) AS amount FROM {INGREDIENTS} i JOIN {MICROS} m ON m.id = i.food_id JOIN {RECIPES} r ON r.id = i.recipe_id GROUP BY i.recipe_id, m.nutrient")
def recipe_micros(spark, d):
    r, i, _ = _recipe_parts(spark, d)
    return S.recipe_micros(r, i, D.frame(spark, d, D.MICROS)).withColumn("amount", _r("amount"))


@_query(f"SELECT i.scan_id, m.nutrient, round(sum(m.amount * coalesce(nullif(i.quantity, 0), 100) / 100), 4) AS amount FROM {ITEMS} i JOIN {MICROS} m ON m.id = i.food_id WHERE m.amount IS NOT NULL GROUP BY i.scan_id, m.nutrient")
def receipt_micros(spark, d):
    return S.receipt_micros(_items(spark, d), D.frame(spark, d, D.MICROS)).withColumn("amount", _r("amount"))


@_query(f"SELECT id, is_list, {', '.join(f'round(kcal * days * {share}e0 / {per}, 4) AS {name}' for name, share, per in (('protein_g', 0.2, 4), ('carbs_g', 0.5, 4), ('sugars_g', 0.1, 4), ('fat_g', 0.3, 9), ('saturated_fat_g', 0.1, 9)))}, 30 * days AS fiber_g, 6 * days AS salt_g FROM (SELECT *, id % 2 = 0 AS is_list, CASE WHEN id % 2 = 0 THEN 7 ELSE 1 END AS days, {_KCAL} AS kcal FROM {PROFILES})")
def receipt_targets(spark, d):
    p = D.frame(spark, d, D.PROFILES)
    kcal = N.energy_target(*(F.col(c) for c in ("sex", "age", "weight", "height", "activity_level", "weight_goal")))
    made = S.receipt_targets(kcal, F.col("id") % 2 == 0)
    return p.select("id", (F.col("id") % 2 == 0).alias("is_list"), *((_r(v) if k not in ("fiber_g", "salt_g") else v).alias(k) for k, v in made.items()))


# Lists and history
@_query(f"SELECT CAST(floor(avg(score) + 0.5) AS INT) AS average_score, count(*) AS n_scans FROM (SELECT coalesce(floor(avg(f.health_score) FILTER (WHERE i.confidence >= 0.45) + 0.5), 0) AS score FROM {ITEMS} i LEFT JOIN {FOODS} f ON f.id = i.food_id GROUP BY i.scan_id)")
def all_scan_average(spark, d):
    foods = _foods(spark, d).select(F.col("id").alias("food_id"), "health_score")
    scores = history.scan_scores(_items(spark, d).join(foods, "food_id", "left"))
    return scores.agg(F.coalesce(N.half_up(F.avg("average_score")), F.lit(0)).cast("int").alias("average_score"), F.count(F.lit(1)).alias("n_scans"))


@_query(f"SELECT coalesce(recipe_name, '') AS recipe_name, count(*) OVER (PARTITION BY coalesce(recipe_name, '')) AS n, seq, raw_text FROM (SELECT CASE WHEN i.recipe_id LIKE '%3' THEN NULL ELSE r.name END AS recipe_name, CAST(i.recipe_id AS BIGINT) * 10 + i.sort_order AS seq, i.raw_text FROM {INGREDIENTS} i JOIN {RECIPES} r ON r.id = i.recipe_id)")
def items_by_recipe(spark, d):
    """A list's items by recipe, and those that belong to none."""
    r, i, _ = _recipe_parts(spark, d)
    name = F.when(~F.col("recipe_id").like("%3"), F.col("name"))
    rows = i.join(r.select(F.col("id").alias("recipe_id"), "name"), "recipe_id").withColumns({"recipe_name": name, "seq": F.col("recipe_id").cast("long") * 10 + F.col("sort_order")})
    return S.with_group_size(rows, "recipe_name").select("recipe_name", "n", "seq", "raw_text")


@_query(f"SELECT food_id, recipe_id, CAST(k AS INT) AS place FROM (SELECT food_id, recipe_id, row_number() OVER (PARTITION BY food_id ORDER BY CAST(recipe_id AS BIGINT)) AS k FROM (SELECT DISTINCT food_id, recipe_id FROM {INGREDIENTS} WHERE food_id IS NOT NULL)) WHERE k <= 2")
def recipes_of_food(spark, d):
    """The first two recipes that use each food."""
    return S.recipes_with_food(D.frame(spark, d, D.INGREDIENTS), 2).select("food_id", "recipe_id", F.col("place").cast("int").alias("place"))


@_query("SELECT event_id, epoch_ms(CAST(iso AS TIMESTAMP)) AS epoch_ms, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(iso AS TIMESTAMP) DESC, event_id DESC) AS INT) AS place FROM (SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso FROM events)")
def scans_by_date(spark, d):
    """Each user's entries newest first, dates parsed from ISO text."""
    e = _table(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("iso"))
    at = F.col("iso").cast("timestamp_ntz")
    place = F.row_number().over(history.Window.partitionBy("user_id").orderBy(at.desc(), F.desc("event_id")))
    return e.select("event_id", F.unix_millis(F.to_timestamp_ltz(F.concat("iso", F.lit("Z")))).alias("epoch_ms"), place.cast("int").alias("place"))


@_query("SELECT id, map_extract(m, 'theme')[1] AS theme, map_extract(m, 'lookup')[1] AS lookup, map_extract(m, 'unit')[1] AS unit FROM (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN map_concat(map {'theme': 'light', 'lookup': 'false', 'unit': 'g'}, map {'theme': 'dark'}) WHEN 1 THEN map_concat(map {'theme': 'light', 'lookup': 'false', 'unit': 'g'}, map {'lookup': 'true', 'unit': 'oz'}) ELSE map {'theme': 'light', 'lookup': 'false', 'unit': 'g'} END AS m FROM customer)")
def settings_merge(spark, d):
    """Stored settings over the defaults."""
    stored = F.when(F.col("id") % 3 == 0, F.from_json(F.lit('{"theme": "dark"}'), "map<string,string>")).when(F.col("id") % 3 == 1, F.from_json(F.lit('{"lookup": "true", "unit": "oz"}'), "map<string,string>"))
    defaults = F.create_map(*(F.lit(x) for x in ("theme", "light", "lookup", "false", "unit", "g")))
    rows = _table(spark, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("m", S.merge_defaults(defaults, stored))
    return rows.select("id", *(F.col("m")[k].alias(k) for k in ("theme", "lookup", "unit")))


# Cards and labels
@_query(f"SELECT i.seq, CASE WHEN f.name IS NOT NULL AND i.confidence >= 0.45 THEN CASE WHEN i.event_type = 'view' AND i.user_id % 2 = 0 THEN 'Product ' || CAST(i.user_id AS VARCHAR) ELSE f.name END ELSE 'line ' || CAST(i.seq AS VARCHAR) END AS shown FROM {ITEMS} i LEFT JOIN {FOODS} f ON f.id = i.food_id")
def display_names(spark, d):
    rows = _items(spark, d).join(_foods(spark, d).select(F.col("id").alias("food_id"), "name"), "food_id", "left")
    source, display = F.when(F.col("event_type") == "view", "off"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Product "), F.col("user_id").cast("string")))
    return rows.select("seq", S.display_name(source, display, F.col("name"), F.col("confidence"), F.concat(F.lit("line "), F.col("seq").cast("string"))).alias("shown"))


@_query(rf"SELECT recipe_id, sort_order, CASE WHEN hit <> '' THEN hit ELSE array_to_string(string_split(raw_text, ' ')[1:2], ' ') END AS amount FROM (SELECT recipe_id, sort_order, raw_text, regexp_extract(raw_text, '[\d½¼¾⅓⅔]+\s*\w+') AS hit FROM {INGREDIENTS})")
def first_amounts(spark, d):
    return D.frame(spark, d, D.INGREDIENTS).select("recipe_id", "sort_order", S.first_amount(F.col("raw_text")).alias("amount"))


@_query("SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)), ',', '.') AS thousands, strftime(o_orderdate, '%a, %b %-d') AS short_date, strftime(o_orderdate, '%a, %B %-d, %Y') AS long_date FROM orders")
def labels(spark, d):
    """Numbers with German thousands, dates as the lists and the receipt show them."""
    return _table(spark, d, "orders").select("o_orderkey", S.german_thousands(N.half_up(F.col("o_totalprice"))).alias("thousands"), F.date_format("o_orderdate", "EEE, MMM d").alias("short_date"), F.date_format("o_orderdate", "EEE, MMMM d, yyyy").alias("long_date"))


@_query(f"""SELECT id, CASE WHEN health_score >= 75 THEN 'green' WHEN health_score >= 50 THEN 'yellow' ELSE 'red' END AS score_colour, CASE WHEN health_score >= 70 THEN 'green' WHEN health_score >= 40 THEN 'yellow' ELSE 'red' END AS ring_colour,
  CASE WHEN health_score >= 80 THEN 'excellent' WHEN health_score >= 65 THEN 'good' WHEN health_score >= 50 THEN 'fair' ELSE 'poor' END AS label,
  CASE WHEN health_score <= 40 THEN 'green' WHEN health_score <= 70 THEN 'amber' ELSE 'red' END AS low_bar, CASE WHEN health_score >= 65 THEN 'green' WHEN health_score >= 35 THEN 'amber' ELSE 'red' END AS high_bar FROM {FOODS}""")
def score_bands(spark, d):
    x = F.col("health_score")
    return _foods(spark, d).select("id", S.colour_band(x).alias("score_colour"), S.colour_band(x, 70, 40).alias("ring_colour"), N.score_band(x).alias("label"), S.bar_band(x, F.lit(True)).alias("low_bar"), S.bar_band(x, F.lit(False)).alias("high_bar"))


@_query(f"SELECT f.id, 'food' AS kind, f.name AS title, f.category, CAST(CAST(floor(coalesce(f.kcal, 0) + 0.5) AS BIGINT) AS VARCHAR) || ' kcal / 100g' AS calories, f.health_score AS score, 'NUTRI SCORE ' || f.nutri_grade AS badge, CASE WHEN f.health_score >= 75 THEN 'green' WHEN f.health_score >= 50 THEN 'yellow' ELSE 'red' END AS colour, CASE {' '.join(f'WHEN regexp_matches(lower(f.category), {chr(39)}{'|'.join(parts)}{chr(39)}) THEN {chr(39)}{icon}{chr(39)}' for icon, parts in W.ICONS)} ELSE 'fast-food-outline' END AS icon, f.id IN (SELECT food_id FROM {ITEMS} WHERE event_type = 'click' AND food_id IS NOT NULL) AS favourite FROM {FOODS} f WHERE contains(lower(f.name), 'bread') OR contains(lower(f.category), 'bread')")
def search_cards(spark, d):
    liked = _items(spark, d).where("event_type = 'click' and food_id is not null").select(F.col("food_id").alias("id"))
    return S.food_cards(search.search_foods(_foods(spark, d), "bread"), liked)


@_query(f"SELECT id, CASE WHEN kcal % 1 = 0 THEN CAST(CAST(kcal AS BIGINT) AS VARCHAR) ELSE printf('%.1f', kcal) END AS kcal, CASE WHEN fat_g % 1 = 0 THEN CAST(CAST(fat_g AS BIGINT) AS VARCHAR) ELSE printf('%.1f', fat_g) END AS fat_g FROM {FOODS}")
def number_texts(spark, d):
    return _foods(spark, d).select("id", N.number_text(F.col("kcal")).alias("kcal"), N.number_text(F.col("fat_g")).alias("fat_g"))


@_query(f"""SELECT recipe_id, CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min' WHEN h % 1 = 0 THEN CAST(CAST(h AS BIGINT) AS VARCHAR) || ' hr' ELSE printf('%.1f', h) || ' hr' END AS time_text, CASE WHEN linked >= 7 OR chars > 600 THEN 'Medium' ELSE 'Easy' END AS difficulty
FROM (SELECT *, floor(m / 60 * 10 + 0.5) / 10 AS h FROM (SELECT recipe_id, count(food_id) AS linked, sum(length(raw_text)) AS chars, 10 + count(*) * 5 + count(food_id) * 2 AS m FROM {INGREDIENTS} GROUP BY recipe_id))""")
def recipe_effort(spark, d):
    """Time and difficulty; the ingredient texts stand for the steps."""
    per = D.frame(spark, d, D.INGREDIENTS).groupBy("recipe_id").agg(F.collect_list("raw_text").alias("steps"), F.count("food_id").alias("linked"))
    time, level = N.time_and_difficulty(F.col("steps"), F.col("linked"))
    return per.select("recipe_id", time.alias("time_text"), level.alias("difficulty"))


# Hold-out evaluation
_DICTIONARY = f"(SELECT lower(name) AS key, name AS food_name FROM {FOODS} WHERE row_ord % 6 = 0)"
_HELD = "CAST('0x' || substr(md5({0} || ':3'), 1, 4) AS INT) < 19660"


@_query(f"""
WITH l AS (SELECT line_id, lower(trim(raw_text)) AS line FROM {LINES}),
hit AS (SELECT line_id, bkey, regexp_matches(line, '(^|[^a-zäöüß])' || bkey || '($|[^a-zäöüß])') AS whole FROM l JOIN {_BRANDS} ON contains(line, bkey)
  WHERE regexp_matches(' ' || regexp_replace(line, bkey || '[a-zäöüß]*(mus|mark|saft|öl|oel|creme|brei)($|[^a-zäöüß])', '#\\2', 'g'), bkey)),
brand AS (SELECT line_id, bkey FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY whole DESC, length(bkey) DESC, bkey) AS k FROM hit) WHERE k = 1),
governed AS (SELECT l.line_id, CASE WHEN e.key IS NOT NULL THEN 'exact' ELSE 'brand' END AS tier, coalesce(e.key, b.bkey) AS key FROM l LEFT JOIN (SELECT DISTINCT key FROM {_DICTIONARY}) e ON e.key = l.line LEFT JOIN brand b ON b.line_id = l.line_id WHERE e.key IS NOT NULL OR b.bkey IS NOT NULL)
SELECT line_id, tier, key, {_HELD.format('key')} AS held_out FROM governed""")
def holdout_lines(spark, d):
    """Which dictionary entry decides each line, and whether it is among the held-out 30 %."""
    brands = spark.sql(f"SELECT bkey AS key, food_name FROM {_BRANDS}")
    dictionary = _foods(spark, d).where("row_ord % 6 = 0").select(F.lower("name").alias("key"), F.col("name").alias("food_name"))
    return S.held_out_keys(S.governed_lines(D.frame(spark, d, D.NOISY_LINES), dictionary, brands, matching.brand_hits), 0.3, 3)


@_query()
def holdout_accuracy(spark, d):
    """Lines that a withheld key decides, by tier: right with all keys, with the keys that are left, and by the fuzzy matcher alone."""
    lines, foods = D.frame(spark, d, D.NOISY_LINES), _foods(spark, d)
    known = reference(spark, d)
    answers = pipelines.holdout_resolution(lines, foods, known.dictionary, known.brands)
    return pipelines.holdout_accuracy(answers, lines.select("line_id", F.col("line_id").alias("expected")))


# Resolution with external products, and the whole scan pipeline
def reference(spark, d) -> pipelines.Reference:
    """Overrides, dictionary, brands, non-matches and products derived from the catalog and its lines."""
    foods, lines = _foods(spark, d), D.frame(spark, d, D.NOISY_LINES)
    dish = F.regexp_replace(F.lower(F.concat_ws(" ", F.element_at(F.split("swiss_category", "/"), -1))), "[^a-z]+", "-")
    named = lines.join(foods.select(F.col("id").alias("line_id"), "name", "category", dish.alias("dish")).hint("merge"), "line_id").where("cast(line_id as long) % 5 <> 0")
    tags = F.array(F.lit("de:lebensmittel"), F.concat(F.lit("en:"), F.lower("category")), F.concat(F.lit("en:"), F.col("dish")), F.concat(F.lit("en:"), F.regexp_replace(F.lower("name"), "[^a-z]+", "-")), F.lit("en:a-very-long-tag-of-many-words"))
    products = pipelines.products_by_line(named.select("line_id", "raw_text", tags.alias("tags"), "name"), F.col("tags"), F.concat(F.lit("Product "), F.col("name")))
    return pipelines.Reference(
        foods=foods,
        products=products,
        **matcher_queries.dictionaries(spark, d),
    )


@_query()
def bridge_resolve(spark, d):
    """Receipt lines through all tiers, the weak ones improved by the best category tag of an external product."""
    known = reference(spark, d)
    items = pipelines.scan_stage("resolved", D.frame(spark, d, D.NOISY_LINES), known, {})
    found = matching.bridge_products(matching.cut(items), known.products, known.foods)
    return found.select("line_id", "food_id", _r("confidence").alias("confidence"), "source", "display_name")


@_query()
def scan_outputs(spark, d):
    """Lines to saved scans: resolved, bridged, weak lines logged, swaps offered, scores saved, each stage a table."""
    lines = D.frame(spark, d, D.NOISY_LINES).withColumn("scan_id", (F.col("line_id").cast("long") % 40).cast("string"))
    tables, _ = pipelines.run_scan_pipeline(lines, reference(spark, d), fresh_folder(spark))
    return tables["scans"]


@_query(f"SELECT id, name, health_score FROM {FOODS} ORDER BY health_score DESC, row_ord LIMIT 20 OFFSET 40")
def food_page(spark, d):
    """The third page of twenty foods, healthy ones first, each page asked for by the last keys of the one before."""
    foods, order, cursor = _foods(spark, d), [("health_score", True), ("row_ord", False)], None
    for _ in range(2):
        cursor = tuple(S.page_after(foods, order, 20, cursor).agg(F.max_by(F.struct("health_score", "row_ord"), F.struct(-F.col("health_score"), "row_ord"))).first()[0])
    return S.page_after(foods, order, 20, cursor).select("id", "name", "health_score")


_OPEN = "replace(props, '\"k\"', CASE event_id % 3 WHEN 0 THEN '\"iron_mg\"' WHEN 1 THEN '\"vitamin_k_ug\"' ELSE '\"other\"' END)"


@_query(f"SELECT user_id, j.key AS nutrient, sum(CAST(j.value AS DOUBLE)) AS amount FROM (SELECT user_id, {_OPEN} AS micros FROM events) e, json_each(e.micros) j WHERE regexp_matches(j.key, '_(mg|ug)$') AND j.type NOT IN ('NULL', 'VARCHAR') GROUP BY user_id, j.key")
def open_micros(spark, d):
    """Each user's micronutrients of JSON objects with any fields."""
    rows = _table(spark, d, "events").select("user_id", F.expr(_OPEN).alias("micros"))
    return loader.open_micros(rows, "user_id", "micros")
