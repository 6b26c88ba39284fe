"""Jobs over receipt lines: hold-out evaluation of the dictionaries, and the scan pipeline with saved stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from larder.functions import text as X
from larder.operators import matching, screens
from larder.operators.history import scan_scores
from larder.operators.learning import accuracy_by


def holdout_resolution(lines: DataFrame, foods: DataFrame, dictionary: DataFrame, brands: DataFrame, share: float = 0.3, seed: int = 3) -> DataFrame:
    """Lines that a withheld key decides: line_id, tier, key, food_full, food_reduced, food_fuzzy.

    ``food_full`` is the withheld key's own food, ``food_reduced`` the answer of the keys that are left
    and else of the fuzzy matcher, ``food_fuzzy`` that of the fuzzy matcher alone (null below MATCH_FLOOR
    confidence).  A text meets its fuzzy match once, whatever the answers.
    """
    columns = ["tier", "key", "food_full", "food_reduced", "food_fuzzy"]
    return matching.by_text(lines.select("line_id", "raw_text"), lambda texts: _holdout_texts(texts, foods, dictionary, brands, share, seed)).select("line_id", *columns)


def _holdout_texts(lines: DataFrame, foods: DataFrame, dictionary: DataFrame, brands: DataFrame, share: float, seed: int) -> DataFrame:
    entries = lambda table: screens.held_out_keys(table, share, seed)
    exact, brand = entries(dictionary), entries(brands)
    governed = screens.held_out_keys(screens.governed_lines(lines, dictionary, brands, matching.brand_hits), share, seed).where("held_out").drop("held_out")
    mine = matching.cut(lines.join(governed, "line_id"))
    left = lambda table: table.where(~F.col("held_out")).drop("held_out")
    names = matching.food_names(foods)
    by_exact = lambda table, name: matching.exact_tier(mine.select("line_id", "raw_text"), table, foods).withColumnRenamed("food_id", name)
    by_brand = lambda table, name: matching.brand_hits(mine.select("line_id", "raw_text"), table).join(names, "food_name").select("line_id", F.col("id").alias(name))
    fuzzy = matching.parse_lines(mine.select("line_id", "raw_text"), foods).where(F.col("confidence") >= screens.MATCH_FLOOR).select("line_id", F.col("food_id").alias("food_fuzzy"))
    rows = mine
    for found in (by_exact(dictionary, "e_full"), by_brand(brands, "b_full"), by_exact(left(exact), "e_left"), by_brand(left(brand), "b_left"), fuzzy):
        rows = rows.join(found, "line_id", "left")
    full = F.when(F.col("tier") == "exact", F.col("e_full")).otherwise(F.col("b_full"))
    return rows.select("line_id", "tier", "key", full.alias("food_full"), F.coalesce("e_left", "b_left", "food_fuzzy").alias("food_reduced"), "food_fuzzy")


def holdout_accuracy(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """tier (and all), n, and how many lines are right with all keys, without the withheld ones, and without any; ``expected`` (line_id, expected)."""
    rows, out = matching.cut(answers.join(expected.hint("merge"), "line_id")), None
    for kind in ("full", "reduced", "fuzzy"):
        part = accuracy_by(rows, "tier", "expected", f"food_{kind}").select("tier", "n", F.col("n_correct").alias(f"{kind}_correct"))
        out = part if out is None else out.join(part.drop("n"), "tier")
    return out


@dataclass(frozen=True)
class Reference:
    """Tables that lines are resolved against."""

    foods: DataFrame
    overrides: DataFrame
    dictionary: DataFrame
    brands: DataFrame
    non_matches: DataFrame
    products: DataFrame
    diets: tuple[str, ...] = ()


STAGES = ("resolved", "items", "weak", "swaps", "scans")


def scan_stage(name: str, lines: DataFrame, known: Reference, earlier: dict[str, DataFrame]) -> DataFrame:
    """One stage's table; ``lines`` (scan_id, line_id, raw_text), ``earlier`` the tables of the stages before."""
    if name == "resolved":
        return matching.resolve_lines(lines.select("line_id", "raw_text"), known.foods, known.overrides, known.dictionary, known.brands, known.non_matches)
    if name == "items":
        bridged = matching.bridge_products(earlier["resolved"], known.products, known.foods)
        return bridged.join(lines.select("line_id", "scan_id").hint("merge"), "line_id")
    items = earlier["items"]
    if name == "weak":
        return screens.weak_matches(items).select("scan_id", "line_id", "raw_text", "food_id", "confidence", "source")
    if name == "swaps":
        sure = items.where(F.col("food_id").isNotNull() & (F.col("confidence") > screens.WEAK_BELOW)).select(F.col("food_id").alias("id")).distinct()
        return screens.discovered_swaps(known.foods, sure, list(known.diets)).select("food_id", "swap_id", "improvement")
    health = known.foods.select(F.col("id").alias("food_id"), "health_score")
    scores = scan_scores(items.join(health, "food_id", "left"), screens.MATCH_FLOOR)
    sure = F.col("food_id").isNotNull() & (F.col("confidence") > screens.WEAK_BELOW)
    offers = items.join(earlier["swaps"], "food_id", "left").groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(sure & F.col("improvement").isNotNull()).alias("n_swaps"), F.coalesce(F.sum(F.when(sure, F.col("improvement"))), F.lit(0)).alias("improvement"))
    weak = earlier["weak"].groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_weak"))
    return scores.join(offers, "scan_id").join(weak, "scan_id", "left").select("scan_id", "average_score", "n_items", F.coalesce("n_weak", F.lit(0)).alias("n_weak"), "n_swaps", "improvement")


def _written(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def run_scan_pipeline(lines: DataFrame, known: Reference, path: str) -> tuple[dict[str, DataFrame], dict[str, dict]]:
    """All stages written below ``path``: their tables by name, and the observed rows and means of those that ran.

    A stage whose table is complete is read and not run again, so a job that
    was stopped goes on where it was; a half-written table is replaced.
    """
    spark, tables, metrics = lines.sparkSession, {}, {}
    for name in STAGES:
        place = f"{path}/{name}"
        if not _written(spark, place):
            made = scan_stage(name, lines, known, tables)
            watched = Observation(name)
            more: list[Column] = [F.avg("confidence").alias("confidence")] if "confidence" in made.columns else []
            made.observe(watched, F.count(F.lit(1)).alias("rows"), *more).write.mode("overwrite").parquet(place)
            metrics[name] = watched.get
        tables[name] = spark.read.parquet(place)
    return tables, metrics


def products_by_line(lines: DataFrame, tags: Column, name: Column) -> DataFrame:
    """(query, product_name, categories_tags): one product for each normalised line."""
    keyed = matching.by_text(lines, lambda texts: texts.select("line_id", X.override_key(F.col("raw_text")).alias("query")))
    rows = keyed.select("query", name.alias("product_name"), tags.alias("categories_tags"), "line_id").where("query <> ''")
    return rows.groupBy("query").agg(F.min_by(F.struct("product_name", "categories_tags"), "line_id").alias("p")).select("query", "p.*")
