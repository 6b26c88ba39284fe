"""The registered queries on the smallest driver tables: contract columns, SQL, and the pipeline against a plain chain."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import language_id, packing, registry, toxicity

sys.path.insert(0, os.path.dirname(__file__))
from test_llm_operators import brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
COLUMNS = {
    "op1_ann": ["query_id", "rank", "vec_id", "score"],
    "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4_toxicity": ["doc_id", "p_low_quality", "p_toxic", "toxic"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_lm_score": ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
    "op9_html_text": ["page_id", "url", "text", "n_chars"],
    "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op11_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    got = registry.queries()[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.count()
    if name in ("op4_toxicity", "op6_language_id", "op7_near_dedup", "op8_lm_score", "op10_decontaminate", "op12_fill_in_middle", "op13_quality_rules"):
        assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()
    elif name in ("op2_url_filter", "op3_warc", "op9_html_text"):
        assert rows == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF).select(want.columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want.fetchall()))


def contaminated(texts, items):
    """The contract's rule with sets of word windows."""
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = set()
    for t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes, out = {len(w) for w in windows}, []
    for t in texts:
        w, hit = words(t), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        out.append(len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_pipeline_equals_a_plain_chain(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, learn=~language_id.held_out())
    left = [r for r in docs.orderBy("doc_id").collect() if not model.predict([r.text])[2][0]]
    table = spark.createDataFrame(left, docs.schema)
    chain = toxicity.fit(table, toxicity.label_categories(spark.read.parquet(f"{SF}/labels.parquet")), toxicity.CATEGORIES)
    left = [r for r in left if not chain.predict([r.text])[1][0]]
    kept, _ = brute_components([r.text for r in left])
    left = [r for i, r in enumerate(left) if kept[i] == i]
    bad = contaminated([r.text for r in left], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = [r for r, x in zip(left, bad, strict=True) if not x]
    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    want = {r.doc_id: len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in left}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id: r.n for r in got} == want == {r.doc_id: r.d for r in got}
    assert 0 < len(want) < docs.count()


@pytest.mark.parametrize("stage", [corpus_pipeline.identify_language, corpus_pipeline.drop_toxic])
def test_model_stages(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0), (10**6 + 1, "word " * 60_000, None, None, 1), (10**6 + 2, "12 34", "xx", "s", 1)]
    table = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("own")).withColumn("toxic", F.lit("own"))
    got = stage(spark, table, SF)
    assert got.columns == table.columns and got.where("score = 'own' and toxic = 'own'").count() == got.count() > 100
    assert stage(spark, docs.limit(0), SF).count() == 0
