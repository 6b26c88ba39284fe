"""Hold-out evaluation, the bridge and the scan pipeline against sequential counterparts over the whole smallest tables."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_matcher import embedded

from larder.functions import text as X
from larder.operators import history, matching, pipelines, screens
from larder.plans import screen_queries as Q, testdata as D

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def lines(spark):
    return D.frame(spark, SF, D.NOISY_LINES).withColumn("scan_id", (F.col("line_id").cast("long") % 40).cast("string")).cache()


@pytest.fixture(scope="module")
def known(spark):
    return Q.reference(spark, SF)


def first_by_name(foods):
    names = {}
    for r in sorted(foods.select("row_ord", "id", "name", "name_de").collect()):
        for name in (r.name_de, r.name):
            if name is not None:
                names.setdefault(name, r.id)
    return names


def test_holdout(spark, lines, known):
    names = first_by_name(known.foods)
    pick = lambda t: {r.key: r.food_name for r in t.collect()}
    dictionary, brands = pick(known.dictionary), pick(known.brands)
    brands |= {"cola": "cola zero", "bier": "beer", "apfel": "apple"}  # short keys, whose foods are not in the catalog
    brand_table = spark.createDataFrame(list(brands.items()), "key string, food_name string")
    held = lambda t: {r.key for r in screens.held_out_keys(t, 0.3, 3).where("held_out").collect()}
    held_exact, held_brand = held(known.dictionary), held(brand_table)

    def best(line, keys):
        hit = max(((embedded(line, k), len(k), [-ord(c) for c in k], k) for k in keys if embedded(line, k)), default=None)
        return hit and hit[3]

    rows = lines.select("line_id", "raw_text").collect()
    product = {r.line_id for r in lines.where(X.is_product_line(F.col("raw_text"))).collect()}
    fuzzy = {r.line_id: r.food_id for r in matching.fuzzy_match(lines, known.foods).collect() if r.confidence >= 0.45 and r.line_id in product}
    want = {}
    for r in rows:
        low = r.raw_text.strip().lower()
        tier, key = ("exact", low) if low in dictionary else ("brand", best(low, brands))
        if key is None or key not in (held_exact if tier == "exact" else held_brand):
            continue
        full = names.get((dictionary if tier == "exact" else brands)[key])
        left = best(low, set(brands) - held_brand)
        reduced = (names.get(dictionary[low]) if low in dictionary and low not in held_exact else None) or (names.get(brands[left]) if left else None) or fuzzy.get(r.line_id)
        want[r.line_id] = (tier, key, full, reduced, fuzzy.get(r.line_id))
    answers = pipelines.holdout_resolution(lines.drop("scan_id"), known.foods, known.dictionary, brand_table)
    got = {r.line_id: (r.tier, r.key, r.food_full, r.food_reduced, r.food_fuzzy) for r in answers.collect()}
    assert got == want and {t for t, *_ in want.values()} == {"exact", "brand"} and len(want) > 10
    expected = lines.select("line_id", F.col("line_id").alias("expected"))
    table = {r.tier: (r.n, r.full_correct, r.reduced_correct, r.fuzzy_correct) for r in pipelines.holdout_accuracy(answers, expected).collect()}
    for tier in ("exact", "brand", "all"):
        mine = [(k, v) for k, v in want.items() if tier in ("all", v[0])]
        assert table[tier] == (len(mine), *(sum(v[p] == k for k, v in mine) for p in (2, 3, 4)))


def bridged(lines, known, items):
    """Each weak line's best tag, one tag after another."""
    rows = {r.line_id: r for r in items.collect()}
    query = {r.line_id: r.q for r in lines.select("line_id", X.override_key(F.col("raw_text")).alias("q")).collect()}
    products = {r.query: r for r in known.products.collect()}
    clean = {r.t: r.c for r in known.products.select(F.explode("categories_tags").alias("t")).distinct().select("t", X.clean_tag(F.col("t")).alias("c")).collect()}
    asked = []
    for i, r in rows.items():
        if r.source != "override" and (r.food_id is None or r.confidence < 0.45) and query[i] in products:
            asked += [(f"{i}#{k}", clean[t], i, k) for k, t in enumerate(t for t in products[query[i]].categories_tags if t.startswith("en:")) if len(clean[t]) >= 3 and len(clean[t].split(" ")) <= 3]
    tags = lines.sparkSession.createDataFrame([(a, b) for a, b, *_ in asked], "line_id string, raw_text string")
    found = {r.line_id: (r.food_id, r.confidence) for r in matching.fuzzy_match(tags, known.foods).collect() if r.confidence >= 0.6}
    best = defaultdict(list)
    for key, _, i, k in asked:
        if key in found:
            best[i].append((found[key][1], -k, found[key][0]))
    out = {}
    for i, r in rows.items():
        top = max(best[i]) if best[i] else None
        out[i] = (top[2], top[0], "off", products[query[i]].product_name) if top else (r.food_id, r.confidence, r.source, None)
    return out


def test_bridge(spark, lines, known):
    resolved = matching.cut(pipelines.scan_stage("resolved", lines, known, {}))
    want = bridged(lines, known, resolved)
    got = {r.line_id: (r.food_id, r.confidence, r.source, r.display_name) for r in Q.queries()["bridge_resolve"](spark, SF).collect()}
    assert got.keys() == want.keys() and Counter(s for _, _, s, _ in want.values())["off"] > 3
    assert all(got[k][0] == want[k][0] and got[k][2:] == want[k][2:] and abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_scan_pipeline_outputs_and_restart(spark, lines, known, tmp_path):
    tables, metrics = pipelines.run_scan_pipeline(lines, known, f"{tmp_path}/job")
    assert list(tables) == list(pipelines.STAGES) == list(metrics)
    items = tables["items"]
    assert metrics["items"]["rows"] == items.count() and 0 < metrics["items"]["confidence"] < 1
    rows = lambda frame: sorted(map(str, (tuple(r) for r in frame.collect())))
    single = matching.bridge_products(matching.cut(matching.resolve_lines(lines.select("line_id", "raw_text"), known.foods, known.overrides, known.dictionary, known.brands, known.non_matches)), known.products, known.foods)
    assert rows(items.select(single.columns)) == rows(single)
    assert tables["weak"].count() == screens.weak_matches(items).count()
    summary = screens.scan_summary(items, known.foods, [])
    assert rows(tables["scans"].select(summary.columns)) == rows(summary)
    health = known.foods.select(F.col("id").alias("food_id"), "health_score")
    assert rows(tables["scans"].select("scan_id", "average_score")) == rows(history.scan_scores(items.join(health, "food_id", "left")))
    # a job that was stopped in the fourth stage runs that and the last one
    before = rows(tables["scans"])
    for stage in ("swaps", "scans"):
        os.rename(f"{tmp_path}/job/{stage}", f"{tmp_path}/gone-{stage}")
    os.makedirs(f"{tmp_path}/job/swaps/_temporary")
    tables, metrics = pipelines.run_scan_pipeline(lines, known, f"{tmp_path}/job")
    assert list(metrics) == ["swaps", "scans"] and rows(tables["scans"]) == before
