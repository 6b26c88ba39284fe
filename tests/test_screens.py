"""Set operations, cards and sources on small tables."""

import json

from pyspark.sql import functions as F

from larder.functions import text as X
from larder.operators import learning, matching, recipes, screens as S, swaps
from larder.sources import tables


def values(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_set_operations(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")], "id string, seq int, v string")
    assert values(S.union_first_wins(rows, "id", ["seq"]), "id", "v") == [("a", "early"), ("b", "only")]
    assert values(S.without(rows, rows.where("id = 'a'"), "id"), "id") == [("b",)]
    assert values(S.reset(rows, rows.where("v = 'only'").select("id"), "id"), "v") == [("early",), ("late",)]
    assert [r.v for r in S.prepend(rows, spark.createDataFrame([("c", 9, "new")], rows.schema), "seq").collect()] == ["new", "only", "late", "early"]
    assert [(r.place, r.v) for r in S.paged(rows, [F.col("seq")], 1, 1).collect()] == [(2, "late")]
    held = S.held_out_keys(spark.range(2000).select(F.col("id").cast("string").alias("key")), 0.3, 1)
    assert 500 < held.where("held_out").count() < 700


def test_merge_defaults(spark):
    rows = spark.createDataFrame([({"a": "2", "c": "3"},), (None,)], "m map<string,string>")
    made = rows.select(S.merge_defaults(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("0")), F.col("m")).alias("x")).collect()
    assert [r.x for r in made] == [{"a": "2", "b": "0", "c": "3"}, {"a": "1", "b": "0"}]


def test_labels(spark):
    rows = spark.createDataFrame([("½ onion", "off", "Brand", "Food", 0.9), ("two big eggs", None, "Brand", "Food", 0.9), ("12g ham", "off", "", "Food", 0.5), ("x", "off", "Brand", "Food", 0.2), ("y", None, None, None, None)], "t string, s string, d string, f string, c double")
    made = rows.select(S.first_amount(F.col("t")).alias("a"), S.display_name(F.col("s"), F.col("d"), F.col("f"), F.col("c"), F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in made] == [("½ onion", "Brand"), ("two big", "Food"), ("12g", "Food"), ("x", "x"), ("y", "y")]
    assert spark.range(1).select(S.german_thousands(F.lit(1234567)).alias("x")).first().x == "1.234.567"


def test_grouped_items_keep_the_ungrouped(spark):
    rows = spark.createDataFrame([(None, 3, "x"), ("soup", 2, "b"), ("soup", 1, "a"), (None, 4, "y")], "recipe string, seq int, text string")
    assert values(S.grouped_items(rows, "recipe", "text", "seq"), "recipe", "n", "texts") == [("", 2, ["x", "y"]), ("soup", 2, ["a", "b"])]


def test_the_later_swap_wins(spark):
    chosen = spark.createDataFrame([("1", "9", 1), ("1", "3", 2), ("2", "4", 1)], "food_id string, swap_id string, seq int")
    assert values(recipes.last_swaps(chosen), "food_id", "swap_id") == [("1", "3"), ("2", "4")]


def test_pair_features_equal_the_plain_counts(spark):
    words = [["ab", "cd", "ab"], ["ab"], [], ["cd", "xy", "ab"], ["q"] * 5, ["ab", "q"] * 6]
    rows = [(i, w, [len(x) % 4 for x in w]) for i, w in enumerate(words)]
    f = spark.createDataFrame(rows, "id int, words array<string>, bins array<int>")
    levels = {f"level{p}": F.expr(f"aggregate(array_distinct(bins), 0L, (held, b) -> held | if(size(filter(bins, x -> x = b)) >= {p}, shiftleft(1L, cast(b as int)), 0L))") for p in range(1, swaps.LEVELS + 2)}
    f = f.withColumns(levels | {"words_ids": F.transform("words", lambda w: F.xxhash64(w))})
    pairs = f.alias("s").crossJoin(f.alias("c")).select(F.col("s.words").alias("a"), F.col("c.words").alias("b"), swaps.n_shared("s", "c", "words").alias("n"), swaps.bin_dot("s", "c").alias("dot"))
    few = f.where("size(words) <= 3")
    short = few.alias("s").crossJoin(few.alias("c")).select(F.col("s.words").alias("a"), F.col("c.words").alias("b"), swaps.n_shared("s", "c", "words", swaps.Shape(3, 0, False)).alias("n"), swaps.bin_dot("s", "c", swaps.Shape(3, 0, False)).alias("dot"))
    assert short.count() == 16
    for r in pairs.collect() + short.collect():
        assert r.n == sum(w in r.b for w in r.a)
    for r in pairs.collect() + short.where((F.size("a") <= swaps.LEVELS) & (F.size("b") <= swaps.LEVELS)).collect():
        assert r.dot == sum(len(x) % 4 == len(y) % 4 for x in r.a for y in r.b)


def test_folds_are_even(spark):
    rows = spark.range(997).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    folded = learning.stratified_folds(rows, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folded if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_accents_fold_by_rule(spark):
    rows = spark.createDataFrame([("Crème Brûlée Ńandú",), ("Käse ß Öl",), ("éclair ő ș",), ("a^b",)], "t string")
    made = rows.select(X.normalize(F.col("t")).alias("n"), X.ascii_fold(F.col("t")).alias("a")).collect()
    assert [tuple(r) for r in made] == [("creme brulee nandu", "creme brulee nandu"), ("käse ß öl", "kaese ss oel"), ("eclair o s", "eclair o s"), ("ab", "ab")]


def test_sources(spark, tmp_path):
    (tmp_path / "foods.json").write_text(json.dumps([{"id": "1", "name": "Milk", "name_de": "", "category": "Dairy", "micros": '{"iron_mg": 1.5}'}, {"id": "2", "name": "Beer"}]))
    foods = tables.load_foods(spark, str(tmp_path / "foods.json")).orderBy("row_ord").collect()
    assert [(r.id, r.name_de, r.micros) for r in foods] == [("1", None, {"iron_mg": 1.5}), ("2", None, {})]
    (tmp_path / "r.csv").write_text('ocr_text,method\n"a ""b"", c",x\nd,\n')
    assert values(tables.load_csv(spark, str(tmp_path / "r.csv")), "ocr_text", "method") == [('a "b", c', "x"), ("d", "")]
    state = spark.createDataFrame([("u", 1, "x"), ("u", 2, "y"), ("v", 3, "z")], "user string, seq int, v string")
    documents = tables.to_document(state, "user")
    assert values(tables.document_rows(documents, "document", "seq int, v string"), "user", "seq", "v") == [("u", 1, "x"), ("u", 2, "y"), ("v", 3, "z")]
    broken = spark.createDataFrame([("w", "not json"), ("x", None)], "user string, document string")
    assert tables.document_rows(broken, "document", "seq int, v string").count() == 0
    named = tables.enrich_german(spark.createDataFrame([("1", " Milk", None), ("2", "Tea", "Tee")], "id string, name string, name_de string"), spark.createDataFrame([("milk", "Milch", 1), ("MILK ", "Vollmilch", 2)], "english string, german string, seq int"))
    assert values(named, "id", "name_de") == [("1", "Vollmilch"), ("2", "Tee")]
    boxes = spark.createDataFrame([("c", 0.101, 0.5), ("a", 0.905, 0.2), ("b", 0.901, 0.6)], "text string, mid_y double, min_x double")
    assert [r.text for r in tables.reading_order(boxes).collect()] == ["a", "b", "c"]


def test_external_products_improve_weak_lines(spark):
    foods = spark.createDataFrame([("1", 0, "potato crisps", "Kartoffelchips"), ("2", 1, "tonic water", None)], "id string, row_ord long, name string, name_de string")
    items = spark.createDataFrame([("l1", "FUNNY CHIPZ", None, 0.0, None), ("l2", "WATER", "2", 0.9, "bls")], "line_id string, raw_text string, food_id string, confidence double, source string")
    products = items.where("line_id = 'l1'").select(X.override_key(F.col("raw_text")).alias("query"), F.lit("Funny Crisps").alias("product_name"), F.array(F.lit("en:potato-crisps"), F.lit("de:chips")).alias("categories_tags"))
    got = {r.line_id: r for r in matching.bridge_products(items, products, foods).collect()}
    assert (got["l1"].food_id, got["l1"].source, got["l1"].display_name) == ("1", "off", "Funny Crisps")
    assert (got["l2"].food_id, got["l2"].source, got["l2"].display_name) == ("2", "bls", None)
