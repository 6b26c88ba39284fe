"""URL filter: pattern rules indexed by their rarest literal token.

A rule is ``host/path-prefix`` with the verdict ``block`` or ``allow``; ``*`` in
the path stands for any run of characters.  It fits its host and all its
subdomains where the url's path starts with the rule's.  The longest fitting
rule decides; of equally long rules, block goes before allow, then the smaller
text.  Without a fitting rule the verdict is ``allow``.

Plan, all of it DataFrame expressions:

1. hosts and paths are cut from the urls, and distinct (host, path) pairs taken;
2. each pair is split into tokens (host labels, complete path segments);
3. tokens that occur in rules are counted over all pairs, and each rule is filed
   under its rarest token;
4. pairs meet rules by an equi join on the token, and only the rules so fetched
   run their regular expression;
5. the longest fit of each pair is joined back to the rows.

Edge cases: a null url, or one without ``://``, has an empty host and an empty
path; no rule fits it.  Rules that are null or have no host are ignored.
Repeated urls and page ids stay as they are, one row out for each row in.  Urls
may be of any length; extra columns are kept, those named as an output column
are replaced.  An
empty rule table allows everything; an empty url table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and path segments that end with a slash."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    parts = F.split(path, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    segments = F.transform(inner, lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.filter(F.concat(labels, segments), lambda t: (F.length(t) > 2) & ~t.contains("*")))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()+?^$|])", r"\\$1")


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rule rows (rule, verdict) with their host, tokens and regular expression."""
    cut_at = F.instr("rule", "/")
    rows = rules.select("rule", "verdict").where(F.col("rule").isNotNull() & F.col("verdict").isin("block", "allow")).distinct()
    rows = rows.withColumn("rule_host", F.translate(F.when(cut_at > 0, F.expr("left(rule, instr(rule, '/') - 1)")).otherwise(F.col("rule")), UPPER, LOWER))
    rows = rows.withColumn("rule_path", F.when(cut_at > 0, F.expr("substr(rule, instr(rule, '/'))")).otherwise(F.lit("")))
    rows = rows.where((F.col("rule_host") != "") & ~F.col("rule_host").contains("*"))
    pattern = F.concat(F.lit(r"(?s)^(?:[^#]*\.)?"), _escaped(F.col("rule_host")), F.lit("#"), F.regexp_replace(_escaped(F.col("rule_path")), r"\*", ".*"))
    return rows.withColumn("pattern", pattern).withColumn("rule_tokens", _tokens(F.col("rule_host"), F.col("rule_path")))


def rules_by_rarest_token(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Each rule once, under that of its tokens which fewest urls have."""
    of_rules = rules.select("rule", "verdict", "pattern", F.explode("rule_tokens").alias("token"))
    wanted = of_rules.select("token").distinct()
    seen = url_tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n_urls"))
    ranked = of_rules.join(seen, "token", "left").withColumn("n_urls", F.coalesce("n_urls", F.lit(0)))
    return ranked.groupBy("rule", "verdict", "pattern").agg(F.min_by("token", F.struct("n_urls", "token")).alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict (columns of these names are replaced)."""
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    pairs = rows.select("host", "path").distinct().where(F.col("host") != "")
    tokens = pairs.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    filed = rules_by_rarest_token(compile_rules(rules), tokens)
    fits = tokens.join(filed, "token").where(F.rlike(F.concat_ws("#", "host", "path"), F.col("pattern")))
    order = F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != "block").alias("b"), F.col("rule").alias("r"))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), order).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES) + " AS rules(rule, verdict)")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
pairs AS (SELECT DISTINCT host, path FROM cut),
fits AS (
  SELECT p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.rule) DESC, r.verdict DESC, r.rule) AS k
  FROM pairs p JOIN rules r
    ON starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
   AND (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1))))
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON c.host = f.host AND c.path = f.path
"""
