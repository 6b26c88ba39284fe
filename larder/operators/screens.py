"""What the application's screens compute: feeds, pages, carousels, logs, cards and labels, as set operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions.nutrition import category_icon, half_up
from larder.operators.matching import by_text
from larder.operators.recipes import diet_recipes, feed
from larder.operators.swaps import FEATURES, cosine, food_features, pair_features, top_swaps
from larder.sources.scratch import cut

WEAK_BELOW, MATCH_FLOOR = 0.72, 0.45
MATCH_LOG_ROWS = 500


# sets of rows


def union_first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(key, "_v.*")


def without(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the chosen."""
    return rows.join(chosen.select(key), key, "left_anti")


def merge_defaults(defaults: Column, stored: Column) -> Column:
    """A map with the stored values over the defaults."""
    known = F.coalesce(stored, F.expr("cast(map() as map<string,string>)"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(known, k)), known)


def prepend(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """A log with new rows, newest first: an append, ordered when read."""
    return log.unionByName(new).orderBy(F.desc(order))


def reset(state: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """A state table without the rows of users who reset theirs."""
    return without(state, users, key)


def seeded_place(key: Column, seed: int) -> Column:
    """A sort key that shuffles rows in a way that the seed fixes."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def paged(rows: DataFrame, order: list[Column], limit: int, skip: int = 0) -> DataFrame:
    """``rows`` with their place (from 1) for one page of an order: a top-k, as far as the page reaches."""
    top = rows.orderBy(*order).limit(skip + limit)
    numbered = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("place") > skip)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], size: int, cursor: tuple | None = None) -> DataFrame:
    """The next ``size`` rows of an order (column, whether falling) after the row with the keys ``cursor``.

    The columns tell rows apart and hold no nulls.  A page costs as much as the first, however
    far down it is: rows before the cursor are filtered out, and only a page is sorted.
    """
    if cursor is not None:
        after, equal = F.lit(False), F.lit(True)
        for (name, falling), value in zip(order, cursor, strict=True):
            after = after | (equal & ((F.col(name) < value) if falling else (F.col(name) > value)))
            equal = equal & (F.col(name) == value)
        rows = rows.where(after)
    return rows.orderBy(*(F.desc(name) if falling else F.asc(name) for name, falling in order)).limit(size)


# screens


def relevant_foods(items: DataFrame, foods: DataFrame, diets: list[str], k: int = 2) -> DataFrame:
    """food_id of every owned food and of its ``k`` best swaps."""
    owned = items.where("food_id is not null").select("food_id").distinct()
    swaps = top_swaps(foods, k, diets, sources=owned).select(F.col("swap_id").alias("food_id"))
    return owned.unionByName(swaps).distinct()


def in_subcategory(recipes: DataFrame, category: str) -> DataFrame:
    """Recipes whose subcategory contains the text; ``All`` keeps every recipe."""
    return recipes if category == "All" else recipes.where(F.lower("subcategory").contains(category.lower()))


def recipe_feed(recipes: DataFrame, linked: DataFrame, totals: DataFrame, relevant: DataFrame, *, diets: list[str], category: str, limit: int, skip: int = 0) -> DataFrame:
    """id, relevance, health_score, place: the most relevant recipes, then the healthiest, then catalog order; place 1 is featured."""
    rows = in_subcategory(diet_recipes(recipes, linked, diets), category)
    rows = feed(rows, linked, relevant).join(totals.select("id", "health_score"), "id")
    return paged(rows, [F.desc("relevance"), F.desc("health_score"), F.col("id").cast("long")], limit, skip).select("id", "relevance", "health_score", "place")


def recipe_results(recipes: DataFrame, linked: DataFrame, totals: DataFrame, hits: DataFrame, *, diets: list[str], category: str, max_kcal: float = 1500, min_score: int = 0, favourites: DataFrame | None = None) -> DataFrame:
    """id, kcal, health_score of the recipes among ``hits`` (id) that pass all filters; 1500 kcal a serving means no cap."""
    rows = in_subcategory(diet_recipes(recipes.join(hits.select("id"), "id", "left_semi"), linked, diets), category)
    rows = rows.select("id").join(totals.select("id", "kcal", "health_score"), "id")
    if max_kcal < 1500:
        rows = rows.where(F.col("kcal") <= max_kcal)
    if min_score > 0:
        rows = rows.where(F.col("health_score") >= min_score)
    return rows if favourites is None else rows.join(favourites.select("id"), "id", "left_semi")


def discovered_swaps(foods: DataFrame, bases: DataFrame, diets: list[str]) -> DataFrame:
    """swap_key, food_id, swap_id, improvement: the best swap of each base food (id)."""
    best = top_swaps(foods, 1, diets, sources=bases.select(F.col("id").alias("food_id"))).select("food_id", "swap_id")
    score = lambda key, name: foods.select(F.col("id").alias(key), F.col("health_score").alias(name))
    rows = best.join(score("food_id", "_from"), "food_id").join(score("swap_id", "_to"), "swap_id")
    return rows.select(F.concat_ws("-", "food_id", "swap_id").alias("swap_key"), "food_id", "swap_id", (F.col("_to") - F.col("_from")).alias("improvement"))


def carousel(items: DataFrame, foods: DataFrame, diets: list[str], *, size: int = 5, seed: int = 42) -> DataFrame:
    """place, id, spotlight: swaps of bought foods, first seen first, filled up with healthy foods; the first stands in the middle."""
    bought = items.where("food_id is not null").groupBy("food_id").agg(F.min("seq").alias("first_seq"))
    swaps = top_swaps(foods, 2, diets, sources=bought).join(bought, "food_id")
    chosen = union_first_wins(swaps.select(F.col("swap_id").alias("id"), F.lit(0).alias("turn"), "first_seq", "rank"), "id", ["turn", "first_seq", "rank"])
    chosen = chosen.select("id", "turn", "first_seq", "rank", F.lit("").alias("mixed")).orderBy("first_seq", "rank").limit(size)
    spare = without(foods.where("health_score >= 60").select("id"), chosen, "id")
    spare = spare.select("id", F.lit(1).alias("turn"), F.lit(0).cast("long").alias("first_seq"), F.lit(0).alias("rank"), seeded_place(F.col("id"), seed).alias("mixed")).orderBy("mixed").limit(size)
    order = [F.col("turn"), F.col("first_seq"), F.col("rank"), F.col("mixed")]
    rows = paged(chosen.unionByName(spare), order, size)
    n = F.count(F.lit(1)).over(Window.partitionBy())  # at most ``size`` rows
    centre = F.floor((n - 1) / 2) + 1
    place = F.when(F.col("place") == 1, centre).when(F.col("place") - 1 < centre, F.col("place") - 1).otherwise(F.col("place"))
    return rows.select(place.cast("int").alias("place"), "id", (F.col("place") == 1).alias("spotlight"))


def weak_matches(items: DataFrame) -> DataFrame:
    """Items without a food, or matched with less than WEAK_BELOW confidence."""
    return items.where(F.col("food_id").isNull() | (F.col("confidence") < WEAK_BELOW))


def scan_summary(items: DataFrame, foods: DataFrame, diets: list[str]) -> DataFrame:
    """What a scan of resolved items yields: scan_id, average_score, n_items, n_weak, n_swaps and their total improvement.

    Items of at least MATCH_FLOOR confidence make the score; those above
    WEAK_BELOW offer their food's best swap.
    """
    sure = F.col("food_id").isNotNull() & (F.col("confidence") > WEAK_BELOW)
    offered = items.where(sure).select("food_id").distinct()
    best = discovered_swaps(foods, offered.select(F.col("food_id").alias("id")), diets).select("food_id", "improvement")
    scored = items.join(foods.select(F.col("id").alias("food_id"), "health_score"), "food_id", "left").join(best, "food_id", "left")
    counted = F.col("health_score").isNotNull() & (F.col("confidence") >= MATCH_FLOOR)
    weak = F.col("food_id").isNull() | (F.col("confidence") < WEAK_BELOW)
    swap = sure & F.col("improvement").isNotNull()
    return scored.groupBy("scan_id").agg(
        F.coalesce(half_up(F.avg(F.when(counted, F.col("health_score")))), F.lit(0)).cast("int").alias("average_score"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(weak).alias("n_weak"),
        F.count_if(swap).alias("n_swaps"),
        F.coalesce(F.sum(F.when(swap, F.col("improvement"))), F.lit(0)).alias("improvement"),
    )


def recipes_with_food(ingredients: DataFrame, k: int) -> DataFrame:
    """food_id, recipe_id, place: the first ``k`` recipes that use each food.

    Places are limited before the exchange, so a food in most recipes costs k rows a task.
    """
    used = ingredients.where("food_id is not null").select("food_id", "recipe_id").distinct()
    place = F.row_number().over(Window.partitionBy("food_id").orderBy(F.col("recipe_id").cast("long")))
    return used.withColumn("place", place).where(F.col("place") <= k)


def grouped_items(items: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, n, texts: one list's items by recipe in order, those without one under the empty name.

    For the lists of one screen; over many lists use :func:`with_group_size`.
    """
    keyed = items.withColumn("_g", F.coalesce(group, F.lit("")))
    rows = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(order, value))).alias("_v"))
    return rows.select(F.col("_g").alias(group), "n", F.transform("_v", lambda x: x[value]).alias("texts"))


def with_group_size(items: DataFrame, group: str) -> DataFrame:
    """``items`` with n, their group's size; items without a group are one under the empty name.

    Rows stay rows: a group's sizes are summed in each task first, and no group is gathered.
    """
    keyed = items.withColumn(group, F.coalesce(group, F.lit("")))
    return keyed.join(keyed.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)


def decision_rows(decisions: DataFrame, foods: DataFrame) -> DataFrame:
    """``decisions`` (food_id, swap_id) with the ranker's nine features of the two foods."""
    f = cut(food_features(foods))
    pairs = decisions.join(f.select(F.col("id").alias("food_id"), F.struct("*").alias("s")), "food_id").join(f.select(F.col("id").alias("swap_id"), F.struct("*").alias("c")), "swap_id")
    features = pair_features("s", "c", cosine("s", "c"))
    return pairs.withColumns({name: features[name] for name in FEATURES}).drop("s", "c")


def governed_lines(lines: DataFrame, dictionary: DataFrame, brands: DataFrame, brand_hits) -> DataFrame:
    """line_id, tier, key: the dictionary entry that decides each line, an exact one before a brand."""

    def answer(texts: DataFrame) -> DataFrame:
        low = texts.withColumn("key", F.lower(F.trim("raw_text")))
        exact = low.join(dictionary.select("key").distinct(), "key").select("line_id", F.lit("exact").alias("tier"), "key", F.lit(0).alias("_o"))
        brand = brand_hits(texts, brands).select("line_id", F.lit("brand").alias("tier"), "key", F.lit(1).alias("_o"))
        return union_first_wins(exact.unionByName(brand), "line_id", ["_o", "key"]).select("line_id", "tier", "key")

    return by_text(lines.select("line_id", "raw_text"), answer).select("line_id", "tier", "key")


def held_out_keys(entries: DataFrame, share: float, seed: int) -> DataFrame:
    """``entries`` with held_out: about ``share`` of the keys, by a seeded digest of the key."""
    digit = F.conv(F.substring(seeded_place(F.col("key"), seed), 1, 4), 16, 10).cast("int")
    return entries.withColumn("held_out", digit < F.lit(int(share * 65536)))


# cards and labels


def display_name(source: Column, display: Column, food_name: Column, confidence: Column, raw_text: Column) -> Column:
    """The external product's name, the food's, or the line itself where nothing matched well."""
    external = F.when((source == "off") & (display != ""), display)
    return F.when(food_name.isNotNull() & (confidence >= MATCH_FLOOR), F.coalesce(external, food_name)).otherwise(raw_text)


def first_amount(text: Column) -> Column:
    """The first number with its word, else the first two words."""
    hit = F.regexp_extract(text, r"[\d½¼¾⅓⅔]+\s*\w+", 0)
    return F.when(hit != "", hit).otherwise(F.array_join(F.slice(F.split(text, " "), 1, 2), " "))


def german_thousands(value: Column) -> Column:
    return F.replace(F.format_number(value, 0), F.lit(","), F.lit("."))


def colour_band(value: Column, high: float = 75, low: float = 50) -> Column:
    """green, yellow or red: scores at 75/50, rings at 70/40."""
    return F.when(value >= high, "green").when(value >= low, "yellow").otherwise("red")


def bar_band(percent: Column, low_is_better: Column) -> Column:
    down = F.when(percent <= 40, "green").when(percent <= 70, "amber").otherwise("red")
    return F.when(low_is_better, down).otherwise(F.when(percent >= 65, "green").when(percent >= 35, "amber").otherwise("red"))


def food_cards(foods: DataFrame, favourites: DataFrame) -> DataFrame:
    """Search cards of foods: id, title, category, calories, score, badge, colour, icon, favourite."""
    flags = favourites.select("id", F.lit(True).alias("_f")).distinct()
    rows = foods.join(flags, "id", "left")
    grade = F.when(F.coalesce("nutri_grade", F.lit("")) != "", F.concat(F.lit("NUTRI SCORE "), F.col("nutri_grade"))).otherwise("UNGRADED")
    calories = F.concat(half_up(F.coalesce("kcal", F.lit(0.0))).cast("string"), F.lit(" kcal / 100g"))
    return rows.select("id", F.lit("food").alias("kind"), F.col("name").alias("title"), "category", calories.alias("calories"), F.col("health_score").alias("score"), grade.alias("badge"), colour_band(F.col("health_score")).alias("colour"), category_icon(F.col("category")).alias("icon"), F.coalesce("_f", F.lit(False)).alias("favourite"))


def receipt_targets(kcal: Column, is_list: Column) -> dict[str, Column]:
    """A receipt's targets from a day's energy; a shopping list counts as seven days."""
    days = F.when(is_list, 7).otherwise(1)
    energy = kcal * days
    return {"protein_g": energy * 0.2 / 4, "carbs_g": energy * 0.5 / 4, "sugars_g": energy * 0.1 / 4, "fat_g": energy * 0.3 / 9, "saturated_fat_g": energy * 0.1 / 9, "fiber_g": 30 * days, "salt_g": 6 * days}


# micronutrients, one row each

PRESENT = 60  # nutrients told apart by one number's bits


def _by_food(micros: DataFrame, amount: Column) -> tuple[DataFrame, list[str]]:
    """One row a food (food_id), n0, n1, ... the amounts and given0, ... bits of the nutrients it has, and the nutrients' names.

    What is collected has as many rows as there are nutrients.
    """
    names = [r[0] for r in micros.select("nutrient").distinct().orderBy("nutrient").collect()] or [None]
    is_one = lambda n: F.col("nutrient").eqNullSafe(F.lit(n).cast("string"))
    amounts = [F.sum(F.when(is_one(n), amount)).alias(f"n{j}") for j, n in enumerate(names)]
    bits = []
    for k in range(0, len(names), PRESENT):
        bit = F.lit(0).cast("long")
        for j, n in enumerate(names[k : k + PRESENT]):
            bit = F.when(is_one(n), F.lit(1 << j).cast("long")).otherwise(bit)
        bits.append(F.bit_or(bit).alias(f"given{k // PRESENT}"))
    return micros.groupBy(F.col("id").alias("food_id")).agg(*amounts, *bits), names


def _summed(rows: DataFrame, by_food: DataFrame, names: list[str], key: str, scaled) -> DataFrame:
    """(key, nutrient, amount): amounts of the rows' foods, ``scaled``, summed by key for all nutrients in one row.

    Foods come by a merge join: sizes taken from the catalog's file know nothing of what a food's nutrients take.
    """
    joined = rows.join(by_food.hint("merge"), "food_id")
    n_bits = -(-len(names) // PRESENT)
    sums = joined.groupBy(key).agg(*(F.sum(scaled(F.col(f"n{j}"))).alias(f"n{j}") for j in range(len(names))), *(F.bit_or(f"given{k}").alias(f"given{k}") for k in range(n_bits)))
    given = lambda j: F.col(f"given{j // PRESENT}").bitwiseAND(F.lit(1 << j % PRESENT).cast("long")) != 0
    cells = [x for j, n in enumerate(names) for x in (F.lit(n).cast("string"), F.col(f"n{j}"), given(j))]
    return sums.select(key, F.stack(F.lit(len(names)), *cells).alias("nutrient", "amount", "given")).where("given").drop("given")


def recipe_micros(recipes: DataFrame, ingredients: DataFrame, micros: DataFrame) -> DataFrame:
    """recipe_id, nutrient, amount per serving: scaled by grams, absent amounts as 0."""
    by_food, names = _by_food(micros, F.coalesce("amount", F.lit(0.0)))
    used = ingredients.where("food_id is not null").select("recipe_id", "food_id", "grams")
    sums = _summed(used, by_food, names, "recipe_id", lambda amount: amount * F.col("grams") / 100)
    serves = F.coalesce(F.nullif(F.col("serves"), F.lit(0)), F.lit(1))
    return sums.join(recipes.select(F.col("id").alias("recipe_id"), "serves").hint("merge"), "recipe_id").select("recipe_id", "nutrient", (F.col("amount") / serves).alias("amount"))


def receipt_micros(items: DataFrame, micros: DataFrame) -> DataFrame:
    """scan_id, nutrient, amount at the items' quantities (100 g where absent or 0); only amounts that are given."""
    factor = F.coalesce(F.nullif(F.col("quantity"), F.lit(0.0)), F.lit(100.0)) / 100
    by_food, names = _by_food(micros.where("amount is not null"), F.col("amount"))
    used = items.where("food_id is not null").select("scan_id", "food_id", factor.alias("factor"))
    return _summed(used, by_food, names, "scan_id", lambda amount: amount * F.col("factor"))
