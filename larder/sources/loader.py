"""Catalog loading with children, bucketed storage with statistics, and document files out and in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.sources.tables import empty_to_null, to_document

INGREDIENT_DDL = "food_id string, raw_text string, grams double"
RECIPES_DDL = f"id string, name string, serves int, subcategory string, ingredients array<struct<{INGREDIENT_DDL.replace(' string', ': string').replace(' double', ': double')}>>"


def load_recipes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recipes, ingredients) of a JSON array file with nested ingredients; sort_order is their place from 1.

    Recipes without an id are left out with their ingredients; empty food ids become null.
    """
    rows = spark.read.schema(RECIPES_DDL).json(path, multiLine=True).where("id is not null")
    parts = rows.select(F.col("id").alias("recipe_id"), F.posexplode("ingredients").alias("at", "part"))
    parts = parts.select("recipe_id", (F.col("at") + 1).alias("sort_order"), empty_to_null(F.col("part.food_id")).alias("food_id"), "part.raw_text", "part.grams")
    return rows.drop("ingredients"), parts


def store_catalog(foods: DataFrame, recipes: DataFrame, ingredients: DataFrame, database: str, buckets: int = 64) -> None:
    """Saves the three tables with column statistics; foods and ingredients are bucketed by the food, so that they meet without an exchange."""
    spark = foods.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, rows, key in (("foods", foods, "id"), ("ingredients", ingredients, "food_id"), ("recipes", recipes, "id")):
        rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")
        kept = [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))]
        spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS FOR COLUMNS {', '.join(kept)}")


def export_documents(rows: DataFrame, key: str, path: str) -> None:
    """Writes one JSON array document a key, one a line with its key, committed as a whole; an error if there is nothing to write."""
    documents = to_document(rows, key)
    if documents.isEmpty():
        raise ValueError("nothing to export")
    documents.write.mode("errorifexists").json(path)


def import_documents(spark: SparkSession, path: str, key: str, ddl: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of exported documents: rows of arrays of objects that have all required fields, and what was refused, with the reason.

    ``ddl``: the objects' fields.  A document is refused as a whole if it is no
    JSON array, an object if a required field is absent or of another type.
    """
    lines = spark.read.schema(f"{key} string, document string, _broken string").json(path, columnNameOfCorruptRecord="_broken")
    parsed = lines.withColumn("parts", F.from_json("document", "array<variant>"))
    broken = parsed.where(F.col("parts").isNull()).select(key, F.coalesce("document", "_broken").alias("text"), F.lit("no array").alias("reason"))
    parts = parsed.where(F.col("parts").isNotNull()).select(key, F.explode("parts").alias("part"))
    fields = [x.strip().rsplit(" ", 1) for x in ddl.split(",")]
    typed = parts.select(key, F.to_json("part").alias("_text"), *(F.try_variant_get("part", f"$.{name}", kind).alias(name) for name, kind in fields))
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    refused = typed.where(~complete).select(key, F.col("_text").alias("text"), F.lit("field absent").alias("reason"))
    return typed.where(complete).select(key, *(name for name, _ in fields)), broken.unionByName(refused)


def open_micros(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, nutrient, amount: the sum of each guarded field of a JSON object text, whatever fields it has."""
    found = rows.sparkSession.sql(f"SELECT r.{key}, v.key AS nutrient, try_variant_get(v.value, '$', 'double') AS amount FROM {{rows}} AS r, LATERAL variant_explode(try_parse_json(r.{column})) AS v", rows=rows)
    guarded = found.where(F.col("nutrient").rlike("_(mg|ug)$") & F.col("amount").isNotNull())
    return guarded.groupBy(key, "nutrient").agg(F.sum("amount").alias("amount"))
