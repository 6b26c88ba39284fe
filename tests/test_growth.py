"""Steps whose size must not outgrow the input: what a file's size hides, rows without a key, pairs of equal names."""

import os

import pytest
from pyspark.sql import functions as F

from larder.functions import words as W
from larder.operators import matching, recipes, screens, swaps
from larder.plans import testdata as T

SF = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@driver_tables
@pytest.mark.parametrize("kind", ["receipt", "recipe"])
def test_micros_are_not_broadcast(spark, kind):
    micros = T.frame(spark, SF, T.MICROS)
    if kind == "receipt":
        made = screens.receipt_micros(T.frame(spark, SF, T.SCAN_ITEMS), micros)
    else:
        made = screens.recipe_micros(T.frame(spark, SF, T.RECIPES), T.frame(spark, SF, T.INGREDIENTS), micros)
    assert "BroadcastExchange" not in plan(made)


def test_micros_with_holes(spark):
    micros = spark.createDataFrame([("a", "x_mg", 2.0), ("a", "y_mg", None), ("b", "x_mg", 3.0), ("b", None, 5.0)], "id string, nutrient string, amount double")
    used = spark.createDataFrame([("r", "a", 50.0), ("r", "b", 100.0), ("q", "b", None), ("p", None, 9.0)], "recipe_id string, food_id string, grams double")
    served = spark.createDataFrame([("r", 2), ("q", 0), ("p", 1)], "id string, serves int")
    got = {(r.recipe_id, r.nutrient, r.amount) for r in screens.recipe_micros(served, used, micros).collect()}
    assert got == {("r", "x_mg", 2.0), ("r", "y_mg", 0.0), ("r", None, 2.5), ("q", "x_mg", None), ("q", None, None)}
    bought = spark.createDataFrame([("s", "a", 0.0), ("s", "b", 200.0), ("t", "c", 1.0)], "scan_id string, food_id string, quantity double")
    assert {tuple(r) for r in screens.receipt_micros(bought, micros).collect()} == {("s", "x_mg", 8.0), ("s", None, 10.0)}
    assert screens.receipt_micros(bought, micros.limit(0)).count() == 0


@driver_tables
def test_cosines_of_names(spark):
    base = T.frame(spark, SF, T.CATALOG)
    copies = [base.withColumns({"id": F.concat("id", F.lit(f"-{n}")), "row_ord": F.col("row_ord") + 1000 * n, "health_score": F.when(F.col("row_ord") % 9 > 0, F.pmod(F.col("health_score") + 7 * n, F.lit(101)).cast("int"))}) for n in (1, 2)]
    twice = base.where("row_ord % 4 = 0").withColumns({"id": F.concat("id", F.lit("-w")), "name": F.concat("name", F.lit(" zero zero zero butter"))})
    foods = swaps.cut(base.unionByName(copies[0]).unionByName(copies[1]).unionByName(twice))
    pairs, shape = swaps.recipe_pairs(foods)
    pairs = pairs.select(F.col("s.id").alias("id"), swaps.cosine("s", "c", shape).alias("cosine"))
    want = pairs.groupBy("id").agg(F.count(F.lit(1)), F.round(F.max("cosine"), 9), F.round(F.avg("cosine"), 9)).collect()
    got = swaps.recipe_cosines(foods).select("id", "n_candidates", F.round("best", 9), F.round("mean", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 50


def test_rows_without_food_are_dealt(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("recipe_id"), F.lit(1).alias("sort_order"), F.when(F.col("id") % 100 == 0, F.lit("1")).alias("food_id"))
    foods = spark.createDataFrame([("1", "apple")], "id string, name string").hint("merge")
    linked = recipes.linked_ingredients(rows, foods)
    at = linked.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("f_name").alias("known"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = at.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(r.n for r in sizes) == 4000 and sum(r.known for r in sizes) == 40 and max(r.n for r in sizes) < 2000


@driver_tables
@pytest.mark.parametrize("query", ["Cola", ""])
def test_search_joins_only_found_foods(spark, query):
    r, i, f = T.frame(spark, SF, T.RECIPES), T.frame(spark, SF, T.INGREDIENTS), T.frame(spark, SF, T.CATALOG)
    linked = recipes.linked_ingredients(i, f)
    made = recipes.search_recipes(r, linked, query)
    q = query.lower()
    child = linked.where(F.lower("raw_text").contains(q) | F.lower(F.coalesce("f_name", F.lit(""))).contains(q)).select(F.col("recipe_id").alias("id"))
    want = r.join(r.where(F.lower("name").contains(q)).select("id").unionByName(child).distinct(), "id", "left_semi")
    assert sorted(x.id for x in made.collect()) == sorted(x.id for x in want.collect())
    assert query == "" or "LeftOuter" not in plan(made)


def test_texts_are_answered_once(spark):
    lines = spark.createDataFrame([(str(k), None if k == 7 else f"cola {k % 100}") for k in range(300)], "line_id string, raw_text string")
    seen = []

    def answer(texts):
        seen.append((texts.count(), len(texts.inputFiles())))
        return texts.select("line_id", F.length("raw_text").alias("n"))

    got = matching.by_text(lines, answer)
    assert got.count() == 299 and seen == [(100, 4)]  # not one task for all
    brands = spark.createDataFrame([("cola", "cola")], "key string, food_name string")
    assert matching.brand_hits(lines, brands).count() == 299


@driver_tables
def test_food_features_once_a_name(spark):
    base = T.frame(spark, SF, T.CATALOG)
    copies = base.withColumns({"id": F.concat("id", F.lit("-b")), "kcal": F.col("row_ord").cast("double")})
    holes = base.limit(5).withColumns({"id": F.concat("id", F.lit("-c")), "name": F.lit(None).cast("string"), "category": F.lit(None).cast("string")})
    foods = base.unionByName(copies).unionByName(holes)
    made = swaps.food_features(foods)
    plain = swaps.text_features(foods)
    columns = ["id", *sorted(set(plain.columns) - set(foods.columns))]
    as_text = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert as_text(made) == as_text(plain) and len(columns) > 15
    assert "SortMergeJoin" in plan(made)
