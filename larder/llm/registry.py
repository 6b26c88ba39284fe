"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import ann, decontaminate, fill_in_middle, hard_negatives, html_text, language_id, lm_score, near_dedup, packing, quality_rules, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_warc": warc.op3_warc,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_packing": packing.op5_packing,
        "op6_language_id": language_id.op6_language_id,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_html_text": html_text.op9_html_text,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_quality_rules": quality_rules.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_fill_in_middle": fill_in_middle.OP12_SQL,
        "op13_quality_rules": quality_rules.OP13_SQL,
    }
