"""The corpus pipeline on a small table, stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicate_stage(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (2, text + " x", "en", "s", 1), (3, "other words stand in this one", "en", "s", 1), (3, "other words stand in this one", "en", "s", 1), (4, None, None, None, None), (None, "has no id at all here", "en", "s", 1)]
    table = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert got.columns == table.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert corpus_pipeline.drop_near_duplicates(spark, table.limit(0), "").count() == 0


def test_contaminated_stage(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(13))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.createDataFrame([(1, item + " tail", "en", "s", 1), (2, "clean", "en", "s", 1), (3, None, "en", "s", 1)], DOCS)
    got = corpus_pipeline.drop_contaminated(spark, table, str(tmp_path))
    assert got.columns == table.columns and [r.doc_id for r in got.orderBy("doc_id").collect()] == [2, 3]


def test_stages_keep_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "decontaminate", "packing"]


def test_pack_stage(spark):
    table = spark.createDataFrame([(i, "text " * i, "en", "s", 1) for i in range(30)], DOCS)
    got = corpus_pipeline.pack(spark, table, "")
    assert got.agg(F.sum("length")).first()[0] == got.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
