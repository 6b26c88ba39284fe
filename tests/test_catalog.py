"""Catalog operators: hand-computed cases, properties, and rules that must go both ways."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from larder.functions import nutrition as N, text as X
from larder.operators import feedback, history, learning, matching, search, swaps
from larder.plans import screen_queries as catalog_queries, testdata as D
from larder.sources import tables

SF = "/root/testdata/sf0.001"


def one(spark, expr, *values):
    row = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "grams"),
    [(None, 50), ("", 50), ("200g spinach", 200), ("1 tbsp olive oil", 15), ("2 eggs", 110), ("1½ cups", 2520), ("1,000g", 1), ("2 eggplants", 110), ("1 large egg", 30), ("250 x", 250), ("some salt", 50), ("2 cupcakes", 480)],
)
def test_parse_grams(spark, raw, grams):
    df = spark.createDataFrame([(raw,)], "c0 string")
    assert df.select(X.parse_grams(F.col("c0")).alias("x")).first().x == grams


def test_hash_bucket(spark):
    assert one(spark, X.hash_bucket(F.col("c0")), "yoghurt") == 1005031520 % 64


def test_text_functions(spark):
    assert one(spark, X.normalize(F.col("c0")), "Crème-Brûlée  Ä/Ö!") == "creme brulee ä ö"
    assert one(spark, X.ascii_fold(F.col("c0")), "Müsli süß_x") == "muesli suess_x"
    assert one(spark, X.light_stem(F.col("c0")), "tomaten") == "tomat" and one(spark, X.light_stem(F.col("c0")), "reis") == "reis"
    assert one(spark, X.grams(F.col("c0"), 5), "abc") == [] and one(spark, X.grams(F.col("c0"), 5), "abcdef") == ["abcde", "bcdef"]
    assert one(spark, X.split_case(F.col("c0")), "NIPizzaSpeciale") == "NI Pizza Speciale"
    assert one(spark, X.with_lookalikes(F.col("c0")), "T0mate 400g") == "T0mate Tmate Tomate 400g"
    assert one(spark, X.expand_abbreviations(F.col("c0")), "Gr Pudd Bio Penne") == "Gr pudding Penne teigwaren pasta"
    assert one(spark, X.override_key(F.col("c0")), "Milch 1,5% 500ml 0,89 B") == one(spark, X.override_key(F.col("c0")), "MILCH 1,5% 0,99 A")
    assert one(spark, X.head_split(F.col("c0")), "weizenbrot") == ["weizenbrot", "weizen", "brot"]
    assert one(spark, X.fat_percent(F.col("c0")), "Sahne 30,5 % Fett") == 30.5
    assert one(spark, X.user_number(F.col("c0")), "1,5") == 1.5 and one(spark, X.user_number(F.col("c0")), "-2") is None


def test_line_filter_goes_both_ways(spark):
    reject = ["Müllerstraße 141", "SUMME EUR 12,99", "1,99 A", "2 x 0,89", "10247 Berlin.", "www.shop.de", "REWE Markt", "abc", "3 Stk x", "0,500 kg", "Muster GmbH"]
    keep = ["Vollmilch 3,5% 1,09 A", "Bio Bananen", "Joghurt mild 0,59", "Hähnchenbrust 5,99 A"]
    rows = spark.createDataFrame([(x,) for x in reject + keep], "line string")
    got = {r.line: r.ok for r in rows.select("line", X.is_product_line(F.col("line")).alias("ok")).collect()}
    assert not any(got[x] for x in reject) and all(got[x] for x in keep)


def test_every_rule_has_both_outcomes(spark):
    f = swaps.food_features(D.frame(spark, SF, D.CATALOG))
    for flag in ("liquid", "smart_liquid", "raw", "restricted", "sweet", "unsweet"):
        assert f.select(flag).distinct().count() == 2, flag
    assert f.select("eq_group").distinct().count() >= 8 and f.select("role").distinct().count() >= 10


@given(st.lists(st.booleans(), max_size=60))
@settings(max_examples=8, deadline=None)
def test_closed_form_fold(spark, accepted):
    m, a = 1.0, feedback.RATE * feedback.FOOD_SHARE
    for x in accepted:
        m += a * (1.8 - m) if x else -a * (m - 0.3)
        assert 0.3 <= m <= 1.8
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(accepted)], "key string, seq int, accepted boolean")
    got = feedback.preference_fold(rows, ["key"], feedback.FOOD_SHARE).collect()
    assert not accepted or math.isclose(got[0].multiplier, m, rel_tol=1e-9)


def test_profile_defaults(spark):
    row = spark.createDataFrame([("Female", 23.0, 50.0, 170.0, "Lightly Active", "stay")], "sex string, age double, weight double, height double, a string, g string")
    kcal = row.select(N.energy_target(*(F.col(c) for c in row.columns)).alias("k")).first().k
    assert kcal == math.floor((500 + 1062.5 - 115 - 161) * 1.375 + 0.5)


def test_weeks_start_on_monday(spark):
    rows = spark.createDataFrame([("2024-01-07 23:59:00", 10, False), ("2024-01-08 00:00:00", 20, None), ("2024-01-08 01:00:00", 99, True)], "d string, average_score int, is_shopping_list boolean")
    got = history.weekly_groups(rows.withColumn("date", F.col("d").cast("timestamp"))).orderBy("week_start").collect()
    assert [(str(r.week_start), r.n_scans, r.average_score) for r in got] == [("2024-01-01", 1, 10), ("2024-01-08", 1, 20)]


def test_state_operators(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    c = spark.createDataFrame([("b", 5), ("z", 9)], "id string, v int")
    assert sorted(map(tuple, feedback.update_by_key(t, c, "id").collect())) == [("a", 1), ("b", 5)]
    assert [r.id for r in feedback.delete_by_key(t, c, "id").collect()] == ["a"]
    assert sorted(r.id for r in feedback.toggle(t.select("id"), c.select("id"), ["id"]).collect()) == ["a", "z"]


def test_fuzzy_match_finds_damaged_names(spark):
    foods = spark.createDataFrame([("t", 0, "Tomato raw", "Tomate roh"), ("p", 1, "Tomatoes, strained", "Tomaten passiert"), ("j", 2, "Natural yoghurt", "Joghurt nature"), ("m", 3, "Whole milk", "Vollmilch")], "id string, row_ord long, name string, name_de string")
    lines = spark.createDataFrame([("1", "Tomaten 1,99 A"), ("2", "J0ghurt natur"), ("3", "Vollmlich 1L"), ("4", "Schraubenzieher")], "line_id string, raw_text string")
    got = {r.line_id: (r.food_id, r.confidence) for r in matching.parse_lines(lines, foods).collect()}
    assert got["1"][0] == "t" and got["2"][0] == "j" and got["4"] == (None, 0.0)
    assert all(0 <= c <= 0.95 for _, c in got.values())


def test_brand_tier_prefers_whole_words(spark):
    brands = spark.createDataFrame([("tomaten", "Tomate"), ("pflaumen", "Pflaume"), ("apfel", "Apfel")], "key string, food_name string")
    lines = spark.createDataFrame([("1", "Minipflaumen Tomaten"), ("2", "Apfelmus"), ("3", "Bioapfel")], "line_id string, raw_text string")
    got = {r.line_id: r.key for r in matching.brand_hits(lines, brands).collect()}
    assert got == {"1": "tomaten", "3": "apfel"}


def test_learning(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7), int(i % 10 > 4)) for i in range(80)], "id long, a double, b double, is_good int")
    cv = learning.cross_validate(rows, ["a", "b"], "id").collect()
    assert sum(r.n for r in cv) == 80 and min(r.accuracy for r in cv) > 0.8


def test_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"id":"1","name":"Milk","name_de":"","kcal":64,"micros":"{\\"calcium_mg\\":120}"},{"id":"2","name":"Tea","micros":"broken"}]')
    got = tables.load_foods(spark, str(tmp_path / "f.json")).orderBy("row_ord").collect()
    assert got[0].name_de is None and got[0].micros == {"calcium_mg": 120.0} and got[1].micros == {}
    docs = spark.createDataFrame([("k", '[{"a":1},{"a":2}]'), ("x", "broken")], "key string, doc string")
    assert tables.document_rows(docs, "doc", "a int").count() == 2


def test_compare_and_search(spark):
    rows = spark.createDataFrame([("p", 10.0, 20.0)], "k string, a_fiber double, b_fiber double")
    r = search.compare(rows, ["fiber"], {"fiber"}).first()
    assert (r.a_pct, r.b_pct, r.better) == (50.0, 100.0, "b")


def test_registry_names_match():
    assert set(catalog_queries.oracle_sql()) <= set(catalog_queries.queries())


@pytest.mark.parametrize("name", ["fuzzy_match_top1", "tier_resolve"])
def test_every_product_line_is_matched(spark, name):
    lines = {r.line_id for r in D.frame(spark, SF, D.NOISY_LINES).where(X.is_product_line(F.col("raw_text"))).collect()}
    got = [r.line_id for r in catalog_queries.queries()[name](spark, SF).select("line_id").collect()]
    assert len(lines) > 100 and len(got) == len(set(got)) and lines <= set(got)
