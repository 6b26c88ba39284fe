"""Recipes with children, bucketed storage, documents out and in, pages by cursor."""

import json
import os

import pytest
from pyspark.sql import functions as F

from larder.operators import screens
from larder.sources import loader


def test_recipes_round_trip_and_join_without_exchange(spark, tmp_path):
    recipes = [{"id": "r1", "name": "Soup", "serves": 2, "subcategory": "Main", "ingredients": [{"food_id": "f1", "raw_text": "2 eggs", "grams": 110.0}, {"food_id": "", "raw_text": "salt", "grams": None}]}, {"id": "r2", "name": "None", "serves": None, "subcategory": None, "ingredients": []}, {"name": "no id", "ingredients": [{"food_id": "f1"}]}]
    (tmp_path / "r.json").write_text(json.dumps(recipes))
    found, parts = loader.load_recipes(spark, str(tmp_path / "r.json"))
    assert sorted(map(tuple, found.collect()), key=str) == [("r1", "Soup", 2, "Main"), ("r2", "None", None, None)]
    assert [tuple(r) for r in parts.orderBy("sort_order").collect()] == [("r1", 1, "f1", "2 eggs", 110.0), ("r1", 2, None, "salt", None)]
    foods = spark.createDataFrame([(f"f{i}", f"food {i}", i) for i in range(50)], "id string, name string, health_score int")
    loader.store_catalog(foods, found, parts, "larder_test", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("larder_test.ingredients").join(spark.table("larder_test.foods"), F.col("food_id") == F.col("id"))
        assert joined.count() == 1 and "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    stats = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE EXTENDED larder_test.foods health_score").collect()}
    assert (stats["min"], stats["max"], stats["distinct_count"]) == ("0", "49", "50")
    spark.sql("DROP DATABASE larder_test CASCADE")


def test_documents_out_and_in(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, "é \" \\")], "list string, seq int, text string")
    path = str(tmp_path / "out")
    loader.export_documents(rows, "list", path)
    got, refused = loader.import_documents(spark, path, "list", "seq int, text string", ["seq"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and refused.count() == 0
    with pytest.raises(ValueError, match="nothing"):
        loader.export_documents(rows.limit(0), "list", str(tmp_path / "none"))
    broken = [json.dumps({"list": "c", "document": d}) for d in ("{}", "not json", '[{"seq": 4, "text": "t"}, {"text": "no seq"}, {"seq": "four"}, 7]', "[]")] + ["{cut off"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.json").write_text("\n".join(broken))
    got, refused = loader.import_documents(spark, str(tmp_path / "bad"), "list", "seq int, text string", ["seq"])
    assert [tuple(r) for r in got.collect()] == [("c", 4, "t")]
    assert sorted(r.reason for r in refused.collect()) == ["field absent"] * 3 + ["no array"] * 3


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("list"), F.when(F.col("id") == 63, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("seq"))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        loader.export_documents(rows, "list", path)
    assert not os.path.exists(path) or not [f for f in os.listdir(path) if f.startswith(("part", "_SUCCESS"))]


def test_pages_make_up_the_whole_order(spark):
    rows = spark.range(95).select((F.col("id") * 7 % 10).alias("score"), F.col("id").alias("key"))
    order, cursor, seen = [("score", True), ("key", False)], None, []
    while page := screens.page_after(rows, order, 20, cursor).collect():
        seen += [(r.score, r.key) for r in page]
        cursor = seen[-1]
    assert seen == sorted(((i * 7 % 10, i) for i in range(95)), key=lambda x: (-x[0], x[1]))
