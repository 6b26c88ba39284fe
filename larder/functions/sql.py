"""The library's text functions for SQL users: temporary SQL functions, which the optimizer inlines as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from larder.functions import text as X, words as W


def _rewritten(x: str, steps: list[tuple[str, str]]) -> str:
    return reduce(lambda made, step: f"regexp_replace({made}, r'{step[0]}', '{step[1]}')", steps, x)


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, r'\\s+', ' '))"


def _without_marks(x: str) -> str:
    return f"regexp_replace(translate({x}, '{X.ACCENTS}', '{X.PLAIN}'), r'{X.MARKS}', '')"


_UMLAUTS = reduce(lambda x, pair: f"replace({x}, '{pair[0]}', '{pair[1]}')", [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")], "lower(line)")
_WORD_HASH = "aggregate(transform(filter(split(word, ''), c -> c <> ''), c -> cast(ascii(c) AS BIGINT)), 0L, (h, c) -> pmod(h * 31 + c + 2147483648, 4294967296) - 2147483648)"

#: name: parameters, type and body
FUNCTIONS = {
    "normalize_text": ("line STRING", "STRING", _collapsed(_rewritten(_without_marks("lower(line)"), [(r"[.\-/]", " "), (r"[^\w\säöüß]", " ")]))),
    "ascii_fold": ("line STRING", "STRING", _collapsed(_rewritten(_without_marks(_UMLAUTS), [(r"[.\-/]", " "), (r"[^\w\s]", " ")]))),
    "override_key": ("line STRING", "STRING", _collapsed(_rewritten("lower(line)", W.OVERRIDE_STEPS))),
    "light_stem": ("word STRING", "STRING", "CASE WHEN length(word) > 4 THEN regexp_replace(word, '(en|e|n|s)$', '') ELSE word END"),
    "fat_percent": ("line STRING", "DOUBLE", f"try_cast(regexp_replace(regexp_extract(line, r'{W.FAT}', 1), ',', '.') AS DOUBLE)"),
    "hash_bucket": ("word STRING, size INT", "BIGINT", f"abs({_WORD_HASH}) % size"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names; null in, null out."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
