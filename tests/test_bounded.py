"""Swap rankers with bounds against scores of all pairs."""

import os

import pytest
from pyspark.sql import Window, functions as F

from larder.functions import words as W
from larder.operators import swaps
from larder.plans import testdata as T

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def foods(spark):
    """The smallest catalog with copies of foods (ties), a name that a third of the rows share, and nulls."""
    base = T.frame(spark, SF, T.CATALOG)
    copies = base.where("row_ord % 3 = 0").withColumns({"id": F.concat("id", F.lit("-copy")), "row_ord": F.col("row_ord") + 1000})
    common = base.where("row_ord % 2 = 0").withColumns({"id": F.concat("id", F.lit("-hot")), "row_ord": F.col("row_ord") + 2000, "name": F.lit("red gear cola zero zero"), "swiss_category": F.lit("Beverages/Soft drinks"), "category": F.lit("Drinks")})
    holes = base.where("row_ord % 20 = 1").withColumns({"id": F.concat("id", F.lit("-null")), "row_ord": F.col("row_ord") + 3000, "health_score": F.lit(None).cast("int")})
    return swaps.cut(base.unionByName(copies).unionByName(common).unionByName(holes))


def all_pairs(foods, k, condition, score, sources="true", candidates="true"):
    f = swaps.cut(foods)
    pairs = f.where(sources).alias("s").join(f.where(candidates).alias("c"), condition & (F.col("s.id") != F.col("c.id")))
    pairs = pairs.select(F.col("s.id").alias("a"), F.col("c.id").alias("b"), F.col("c.row_ord").alias("o"), score.alias("score"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "o"))
    return {(r.a, r.b, round(r.score, 6)) for r in pairs.withColumn("place", place).where(F.col("place") <= k).collect()}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_swaps(spark, foods, k):
    f = swaps.food_features(foods)
    same, group = F.col("c.swiss_category") == F.col("s.swiss_category"), F.col("c.eq_group") == F.col("s.eq_group")
    branch = ~F.col("s.eq_group").isin(W.STRICT_GROUPS) | ((F.col("s.branch") == F.col("c.branch")) & (F.col("s.branch") != ""))
    score = swaps.swap_score("s", "c") * (swaps.swap_quality(swaps.pair_features("s", "c", swaps.cosine("s", "c"))) + 0.5)
    want = all_pairs(f, k, (F.col("s.liquid") == F.col("c.liquid")) & (same | (group & branch)) & (F.col("c.health_score") >= F.col("s.health_score") + 10), score, "health_score < 80", "not restricted")
    got = {(r.food_id, r.swap_id, round(r.score, 6)) for r in swaps.top_swaps(foods, k).collect()}
    assert got == want and len(want) > 200


def test_recipe_swaps(spark, foods):
    f = swaps.food_features(foods).where(~F.col("role").isin(W.COARSE_ROLES))
    features = swaps.pair_features("s", "c", None) | {"liquid_mismatch": F.lit(0.0), "raw_ingredient_mismatch": F.lit(0.0)}
    score = swaps.swap_score("s", "c") * (swaps.swap_quality(features) + 0.5) * (0.7 + 0.6 * swaps.cosine("s", "c"))
    on = [F.col(f"s.{x}") == F.col(f"c.{x}") for x in ("role", "liquid", "raw")]
    want = all_pairs(f, 1, on[0] & on[1] & on[2] & (F.col("c.health_score") >= F.col("s.health_score") + 10), score, "health_score < 75")
    assert {(r.food_id, r.swap_id, round(r.score, 6)) for r in swaps.recipe_swaps(foods).collect()} == want and len(want) > 10


def test_counts_and_empty(spark, foods):
    counts = {}
    assert swaps.top_swaps(foods.limit(0), counts=counts).count() == 0 and counts["pairs"] == 0
    swaps.top_swaps(foods, counts=counts).count()
    assert 0 < counts["pairs"] + counts["seeds"] < foods.count() ** 2 / 20
