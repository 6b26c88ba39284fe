r"""Fill-in-middle transformation by escaped marker injection.

A text's units are runs of the letters A-Z and a-z, and single other code points.
The plan is DataFrame expressions only, one row out for each row in, no shuffle:

1. the delimiter and the escape character are escaped wherever a text holds
   them, so that a delimiter found later was put there by step 2;
2. ``regexp_replace`` appends the delimiter after every unit (an escape sequence
   is one unit), and counting delimiters counts units;
3. ``substring_index`` cuts the first ``a`` units, the units up to ``b`` and the
   last ``n - b``, with ``a <= b`` drawn from a hash of the id;
4. delimiters are dropped, escapes undone, and the parts assembled around the
   marker strings ``<P>``, ``<S>`` and ``<M>``.

The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
``plain``, the text itself.  :func:`restore` rebuilds the text from output and form.

Edge cases: a null or empty text is plain with no units, and its output is the
empty string.  A text that holds a marker string is plain, whatever the draw, as
its output could not be taken apart.  A null id draws like the empty string.
Repeated rows and ids stay as they are; rows of one id and one text get one
result.  Control characters, also those used as delimiter and escape, are units
like any other character.  Texts may be of any length.  Extra columns are kept,
those named as an output column are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain, and of the others so many put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_DELIMITER, _ESCAPE, _ESCAPED_DELIMITER, _ESCAPED_ESCAPE = "\x01", "\x02", "\x02\x03", "\x02\x04"
_UNIT = "([A-Za-z]+|\x02[\x03\x04]|[^A-Za-z])"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPED_ESCAPE)), F.lit(_DELIMITER), F.lit(_ESCAPED_DELIMITER))


def unescaped(text: Column) -> Column:
    """Every escape character is followed by one of two letters, so that the order of the two steps does not matter."""
    return F.replace(F.replace(text, F.lit(_ESCAPED_DELIMITER), F.lit(_DELIMITER)), F.lit(_ESCAPED_ESCAPE), F.lit(_ESCAPE))


def marked_units(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), _UNIT, f"$1{_DELIMITER}")


def _without_delimiters(text: Column) -> Column:
    return F.replace(text, F.lit(_DELIMITER), F.lit(""))


def draw(id_text: Column, k: int, seed: int = 1) -> Column:
    """The ``k``-th (from 1) group of eight hex digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def substring_index(text: str, count: str) -> Column:
    return F.expr(f"substring_index({text}, '\\u0001', {count})")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` of the given ``form`` was made of."""
    between = lambda left, right: F.substring_index(F.substring_index(output, right, 1), left, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


OUTPUTS = ("n", "form", "prefix", "middle", "suffix", "output")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n, form, prefix, middle, suffix (null if plain) and output."""
    own = [c for c in docs.columns if c not in OUTPUTS or c in (id_col, text_col)]
    rows = docs.select(
        F.struct(*own).alias("own"),
        F.coalesce(text_col, F.lit("")).alias("text"),
        marked_units(F.coalesce(text_col, F.lit(""))).alias("marked"),
        *(draw(F.col(id_col).cast("string"), k, seed).alias(f"h{k}") for k in (1, 2, 3, 4)),
    )
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(_without_delimiters(F.col("marked")))).cast("long"))
    has_marker = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | has_marker | (F.col("h3") % 100 >= 100 - plain_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    one, other = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("own", "text", "marked", F.col("n"), form.alias("form"), F.least(one, other).cast("int").alias("a"), F.greatest(one, other).cast("int").alias("b"))
    part = lambda cut: F.when(F.col("form") != "plain", unescaped(_without_delimiters(cut)))
    # the delimiter after the last unit makes one more piece, the empty one, from the right; up to unit b there is none
    rows = rows.select(
        "own", "text", "n", "form",
        part(substring_index("marked", "a")).alias("prefix"),
        part(substring_index(f"substring_index(marked, '\\u0001', b)", "a - b")).alias("middle"),
        part(substring_index("marked", "CAST(b - n - 1 AS INT)")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.withColumn("output", output).select(*(F.col("own").getField(c).alias(c) for c in own), *OUTPUTS)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
