r"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Words are runs of characters that are not white space, cases as they are.  Words and
pairs of neighbouring words are hashed into ``BUCKETS`` buckets; two multinomials
over the buckets are counted, one over all documents (raw corpus) and one over the
documents of trusted ids (target).  A document's score is the sum over its words
and pairs of ``log(target / raw)`` of their buckets, divided by their number.  The
target is smoothed towards the raw corpus with ``PRIOR`` words or pairs a bucket on
average, so a bucket that few of either are in says little.  The log ratios are rounded to
millionths and summed as integers: every run, partitioning and retry gives the same
scores, and a document is kept if its score is at least the threshold.

The whole plan is DataFrame expressions.  Texts are read twice and not shuffled (but
once, if there are too many trusted ids to broadcast): the first pass sends bucket counts, pre-aggregated in each task, and the second
scores each row by itself.  The table of log ratios, one number a bucket whatever
the corpus, is the one thing that passes the driver.

Repeated words: in each text the windows of three words are named by 40 bits of
their hash and their position in one long, and sorted as primitive longs; neighbours
with one hash are compared word by word.  Should two windows of a text differ
and share a hash, that text's windows are sorted as strings instead, so counts are exact.

Edge cases: a null or empty text, or one of white space, has no words and fails
the base rules.  Very long texts are handled whole.  Documents with a null id are
never trusted.  Repeated rows count as often as they occur and get equal results; an
id that labels both trust and distrust is not trusted.  A score equal to the threshold
keeps a document.  Without trusted documents or without documents all log ratios are
zero, and the base rules alone decide.  Extra columns are kept, those named as an
output column are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larder.llm.common import small_side

BUCKETS, PRIOR = 16_384, 16
#: Millionths: a document is kept from this mean log ratio on.
LEAST_SCORE = -60_000
MIN_WORDS, REPEAT_PERCENT = 50, 50
UNIT = 1_000_000
_SPACE = r"[\x20\x09-\x0D]"
_POSITIONS = 1 << 24
_PAIR = 1_000_003


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{_SPACE}+"), "")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def _window(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def window_keys(pairs: Column) -> Column:
    """For each window of three words 40 bits of a hash of its two pairs over 24 bits of its position."""
    key = lambda of: lambda pair, i: F.xxhash64(pair, F.get(of, i + 1)).bitwiseAND(F.lit(-_POSITIONS)) + i
    keys = let(pairs, lambda of: F.transform(F.slice(of, 1, F.size(of) - 1), key(of)))
    return F.when((F.size(pairs) > 2) & (F.size(pairs) < _POSITIONS - 1), keys).otherwise(F.array().cast("array<bigint>"))


def _same_hash(a: Column, b: Column) -> Column:
    return F.shiftright(a.bitwiseXOR(b), 24) == 0


def repeated_keys(keys: Column) -> Column:
    """Of sorted keys those whose hash a neighbour has."""
    return let(keys, lambda of: F.filter(of, lambda key, i: _same_hash(key, F.get(of, i + 1)) | _same_hash(key, F.get(of, i - 1))))


def _neighbours(items: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """``pair`` of each item and the next, flattened; it gives arrays of ints."""
    return F.flatten(F.zip_with(items, _but_first(items), pair))


def repeated_starts(words: Column, keys: Column) -> Column:
    """Starts of windows that occur twice or more, by repeated keys; holds -1 if two windows of one hash differ."""
    none, odd = F.array().cast("array<int>"), F.array(F.lit(-1))
    at = lambda key: key.bitwiseAND(F.lit(_POSITIONS - 1)).cast("int")
    same = lambda a, b: F.when(_window(words, at(a)) == _window(words, at(b)), F.array(at(a), at(b))).otherwise(odd)
    return _neighbours(keys, lambda a, b: F.when(_same_hash(a, b), same(a, b)).otherwise(none))


def repeated_starts_by_text(words: Column) -> Column:
    """The same by sorting the windows themselves."""
    none = F.array().cast("array<int>")
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(_window(words, i).alias("w"), i.alias("i")))
    return let(F.sort_array(windows), lambda sorted_: _neighbours(sorted_, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(none)))


def covered_words(starts: Column) -> Column:
    """Words in windows of three that begin at ``starts``, distinct and ascending."""
    gaps = F.zip_with(starts, _but_first(starts), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda n, gap: n + gap)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(own, text, words, hashes, pairs): the columns of ``docs`` that stay, the text, its words, their hashes and those of neighbours."""
    own = [c for c in docs.columns if c not in OUTPUTS]
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.struct(*own).alias("own"), text.alias("text"), words_of(text).alias("words"))
    return rows.withColumn("hashes", hashed(F.col("words"))).withColumn("pairs", paired(F.col("hashes")))


def measured(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (own, text, words, hashes, pairs) own, hashes and pairs, with the measures of the base rules."""
    rows = rows.withColumn("keys", window_keys(F.col("pairs"))).withColumn("keys", F.sort_array("keys")).withColumn("keys", repeated_keys(F.col("keys")))
    rows = rows.withColumn("starts", repeated_starts(F.col("words"), F.col("keys")))
    unsure = F.array_contains("starts", F.lit(-1)) | (F.size("words") >= _POSITIONS)
    rows = rows.withColumn("starts", F.sort_array(F.array_distinct(F.when(unsure, repeated_starts_by_text(F.col("words"))).otherwise(F.col("starts")))))
    long = lambda c: c.cast("long")
    rows = rows.select(
        "own", "hashes", "pairs",
        long(F.size("words")).alias("n_words"), long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).alias("n_symbols"),
        long(repeated_lines(F.col("text"))).alias("n_dup_lines"), long(covered_words(F.col("starts"))).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def _but_first(items: Column) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))


def paired(hashes: Column) -> Column:
    """A number for each word and the next."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), _but_first(hashes), lambda a, b: a * _PAIR + b)


def bucket(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """log(target / raw) of each bucket in millionths; ``trusted`` has a column ``trusted_id`` of distinct ids."""
    rows = docs.select(F.col(id_col).alias("trusted_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.join(small_side(trusted.withColumn("is_trusted", F.lit(1))), "trusted_id", "left")  # texts, which are smaller than their hashes
    rows = rows.select("is_trusted", hashed(words_of(F.col("text"))).alias("hashes"))
    rows = rows.select("is_trusted", F.concat("hashes", paired(F.col("hashes"))).alias("grams"))
    # the outer form, as for the other Spark infers a filter that computes the hashes once more
    seen = rows.select("is_trusted", F.explode_outer("grams").alias("gram")).where("gram is not null").select("is_trusted", bucket(F.col("gram")).alias("bucket"))
    counts = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("is_trusted").alias("target"))
    all_buckets = Window.partitionBy(F.lit(0))  # at most BUCKETS rows
    counts = counts.withColumns({"all_raw": F.sum("raw").over(all_buckets), "all_target": F.sum("target").over(all_buckets)})
    # (target + prior * raw / all_raw) / (all_target + prior), divided by raw / all_raw
    prior = PRIOR * BUCKETS
    ratio = (F.col("target") * F.col("all_raw") / F.col("raw") + prior) / (F.col("all_target") + prior)
    table = counts.select("bucket", F.round(F.log(ratio) * UNIT).cast("long").alias("ratio"))
    found = {r.bucket: r.ratio for r in table.collect()}  # at most BUCKETS rows
    return [found.get(b, 0) for b in range(BUCKETS)]


def score_sum(grams: Column, ratios: Column) -> Column:
    """Sum of the log ratios of words or pairs."""
    return F.aggregate(grams, F.lit(0).cast("long"), lambda total, gram: total + F.get(ratios, bucket(gram)))


OUTPUTS = (*MEASURES, "score", "kept")


def judge_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_score: int = LEAST_SCORE) -> DataFrame:
    """``docs`` with the measures, base_failed, score (null without words) and kept."""
    ratios = F.expr(f"cast(split('{' '.join(map(str, log_ratios(docs, trusted, id_col, text_col)))}', ' ') as array<bigint>)")
    rows = measured(with_words(docs, text_col))
    rows = rows.withColumn("total", score_sum(F.col("hashes"), ratios) + score_sum(F.col("pairs"), ratios)).withColumn("grams", 2 * F.col("n_words") - 1)
    kept = ~F.col("base_failed") & (F.col("total") >= least_score * F.col("grams"))
    score = F.when(F.col("n_words") > 0, F.col("total") / F.col("grams") / UNIT)
    own = [c for c in docs.columns if c not in OUTPUTS]
    return rows.select(*(F.col("own").getField(c).alias(c) for c in own), *MEASURES, score.alias("score"), kept.alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids that all labels call good, none of them toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    return rows.where("good").select(F.col("doc_id").alias("trusted_id"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs, trusted).select("doc_id", *MEASURES, "kept", "score")


#: CRC-32 by its table, once for each distinct word.
OP13_SQL = r"""
WITH RECURSIVE polynomial(byte, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM polynomial WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM polynomial WHERE step = 8),
docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
placed AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(word) + 1), lambda j: ('0x' || hex(word)[2 * j - 1:2 * j])::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT word FROM placed), crc_table),
chained AS (
  SELECT k, i, word, h, lead(h) OVER (PARTITION BY k ORDER BY i) AS next_h,
         CASE WHEN lead(word, 2) OVER (PARTITION BY k ORDER BY i) IS NOT NULL
              THEN [word, lead(word) OVER (PARTITION BY k ORDER BY i), lead(word, 2) OVER (PARTITION BY k ORDER BY i)] END AS triple
  FROM placed JOIN hashed USING (word)),
repeats AS (
  SELECT k, count(*) AS n FROM (
    SELECT DISTINCT k, i + o AS at FROM (
      SELECT k, i, count(*) OVER (PARTITION BY k, triple) AS times FROM chained WHERE triple IS NOT NULL), (SELECT unnest([0, 1, 2]) AS o) WHERE times > 1)
  GROUP BY k),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs),
dup_lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
grams AS (
  SELECT k, h & 16383 AS bucket FROM chained
  UNION ALL SELECT k, (h * 1000003 + next_h) & 16383 FROM chained WHERE next_h IS NOT NULL),
trusted AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) = 1),
counted AS (SELECT bucket, count(*) AS raw, count(t.doc_id) AS target FROM grams JOIN docs USING (k) LEFT JOIN trusted t USING (doc_id) GROUP BY bucket),
ratios AS (
  SELECT bucket, round(ln((target * (SELECT sum(raw) FROM counted)::DOUBLE / raw + 262144) / ((SELECT sum(target) FROM counted)::DOUBLE + 262144)) * 1000000)::BIGINT AS ratio
  FROM counted),
totals AS (SELECT k, sum(ratio)::BIGINT AS total, count(*) AS n FROM grams JOIN ratios USING (bucket) GROUP BY k),
measured AS (
  SELECT d.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, t.total, t.n
  FROM docs d LEFT JOIN dup_lines l USING (k) LEFT JOIN repeats r USING (k) LEFT JOIN totals t USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(total >= -60000 * n, false) AS kept,
       total::DOUBLE / n / 1000000 AS score
FROM measured
"""
