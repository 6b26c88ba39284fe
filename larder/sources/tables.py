"""Catalog sources and sinks: schemas, JSON and CSV loaders, document-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.functions.nutrition import MACROS

FOODS_DDL = "id string, name string, name_de string, category string, swiss_category string, health_score int, nutri_grade string, nova_group int, swap_suggestion_id string, " + ", ".join(f"{m} double" for m in MACROS) + ", micros string"


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def load_foods(spark: SparkSession, path: str) -> DataFrame:
    """Foods from a JSON array file: empty texts become null, micros a map, row_ord the file's order."""
    rows = spark.read.schema(FOODS_DDL).json(path, multiLine=True)
    rows = rows.withColumns({c: empty_to_null(F.col(c)) for c in ("name_de", "nutri_grade", "swap_suggestion_id")})
    return rows.withColumn("micros", decode_micros(F.col("micros"))).withColumn("row_ord", F.monotonically_increasing_id())


def decode_micros(text: Column) -> Column:
    """A map of doubles from JSON text; empty for null or broken text."""
    return F.coalesce(F.from_json(text, "map<string,double>"), F.expr("cast(map() as map<string,double>)"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV with a header; absent cells are empty texts."""
    return spark.read.csv(path, header=True, escape='"').fillna("")


def document_rows(documents: DataFrame, column: str, ddl: str) -> DataFrame:
    """Rows of JSON array documents; a broken document has none."""
    parsed = F.from_json(F.col(column), f"array<struct<{ddl}>>")
    rest = [c for c in documents.columns if c != column]
    return documents.select(*rest, F.explode(parsed).alias("_r")).select(*rest, "_r.*")


def to_document(rows: DataFrame, key: str) -> DataFrame:
    """One JSON array document for each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("document"))


def enrich_german(foods: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Foods with German names from (english, german, seq): lower-cased and trimmed, the last entry wins."""
    latest = dictionary.groupBy(F.lower(F.trim("english")).alias("_k")).agg(F.max_by("german", "seq").alias("_de"))
    return foods.join(latest, F.lower(F.trim("name")) == F.col("_k"), "left").withColumn("name_de", F.coalesce("_de", "name_de")).drop("_k", "_de")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Text boxes from top to bottom in bands of 0.01, then from left to right."""
    return boxes.orderBy(F.desc(F.floor(F.col("mid_y") / 0.01)), "min_x")


def flatten_ocr(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw_text) of nested blocks and lines."""
    lines = F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda x: x["text"])))
    return documents.select("doc_id", F.posexplode(lines).alias("line_no", "raw_text"))
