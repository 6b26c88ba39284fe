"""Corpus pipeline: language ID, toxicity, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before has kept, and returns them with the columns of ``documents``; the last
returns packed pieces.  Between stages the rows are written as Parquet in the
folder that the cluster shares, so a lost executor costs one stage at most.

Defined results: documents without a letter are rejected by the first stage, and
null texts with them.  In the near-duplicate stage rows are told apart by id and
text: a group keeps the row that names it, a group of rows without ids keeps
one, and repeated rows leave one.  Empty tables pass through every stage.
Extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm import decontaminate, language_id, near_dedup, packing, toxicity
from larder.llm.common import cut, scratch_dir


def _without(docs: DataFrame, judge, judgement: list[str], gone: str) -> DataFrame:
    """``docs`` without the rows for which the column ``gone`` of ``judge(docs)`` holds; own columns with the judgement's names stay."""
    own = {c: f"_own_{c}" for c in docs.columns if c in judgement}
    kept = judge(docs.withColumnsRenamed(own)).where(~F.col(gone))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject."""
    model = language_id.fit(docs, learn=~language_id.held_out())
    return _without(docs, lambda rows: language_id.identify(rows, model), ["lang_pred", "score", "rejected"], "rejected")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain calls toxic."""
    labels = toxicity.label_categories(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    return _without(docs, lambda rows: toxicity.classify(rows, chain), [*toxicity.CATEGORIES, *(f"p_{c}" for c in toxicity.CATEGORIES)], "toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one that gives the group its id."""
    judged = near_dedup.near_duplicates(docs).select("doc_id", "text_hash", "group_id", "kept")
    # what stays of a group: rows of the least text hash, should rows share the group's id or have none
    stays = judged.where("kept and group_id is not null").groupBy("group_id").agg(F.min("text_hash").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    placed = cut(judged.where("group_id is not null").join(stays, "group_id", "left"))
    gone = placed.where("not kept or text_hash <> _stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    repeated = placed.where("kept and text_hash = _stays and _rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(gone, same_row, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, same_row, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same_row, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda rows: decontaminate.mark_contamination(rows, benchmark), decontaminate.ARROW_OUT.names, "contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: SQL can't train the models; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
