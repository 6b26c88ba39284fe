"""Queries of the matcher's core, each with DuckDB SQL written from the definitions.

The SQL goes the plain way: every line by itself, hits counted food by food, names
scored by list expressions; nothing is shared with the Spark jobs but the word lists.
Confidences are rounded to four places after a billionth is added, so that a half goes
up on either side whatever its last bit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as X, words as W
from larder.operators import matching
from larder.plans import testdata as D
from larder.plans.catalog_queries import _DOC_LINES, _STEM, _TOKEN_SQL, _UMLAUTS, _alt, _clean_sql, _doc_lines, _fold_sql, _foods, _query, _quoted, _r, _table, FOODS, LINES

_WORD = "[A-Za-z0-9_]"
_QUANTITY = r"^(?i)\d+([.,]\d+)?(g|kg|mg|ml|cl|l|stk|st|er)?$"


def _re2(pattern: str) -> str:
    """A pattern for DuckDB, which knows word edges but no looking around."""
    for look in (f"(?<!{_WORD})", f"(?!{_WORD})", "(?<![a-z0-9_])", "(?![a-z0-9_])"):
        pattern = pattern.replace(look, r"\b")
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


def _rewritten(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{_re2(pattern)}', '{by.replace('$', chr(92))}', 'g')"
    return x


def _pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _list(parts: list[str]) -> str:
    return "[" + ", ".join(f"'{p}'" for p in parts) + "]"


def _cases(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _ordered(x: str) -> str:
    """The distinct entries of a list, in their order."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: length(w) >= 3)"


def _raw_form(x: str) -> str:
    return _clean_sql(_fold_sql(f"lower({x})"), "äöüß")


def _ascii_form(x: str) -> str:
    return _clean_sql(_fold_sql(_UMLAUTS.replace("lower(line)", f"lower({x})")), "")


def _fat(x: str) -> str:
    return f"TRY_CAST(replace(regexp_extract({x}, '{_re2(W.FAT)}', 1), ',', '.') AS DOUBLE)"


# Lines
def _is_product(line: str = "line") -> str:
    """Whether a line names a product; ``line`` is a plain column."""
    low, folded = f"lower({line})", _UMLAUTS.replace("lower(line)", f"lower({line})")
    price = f"regexp_matches({low}, '{W.PRICE}')"
    spaced = f"regexp_replace({low}, '[^a-zA-Z0-9_\\s]', ' ', 'g')"
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: regexp_matches(w, '[a-z]{{3,}}') AND w NOT IN {_quoted(W.LINE_UNITS)})"
    rules = [f"(regexp_matches({low if kind == 'line' else folded}, '{_re2(pattern)}')" + (f" AND NOT {price})" if unpriced else ")") for kind, pattern, unpriced in W.LINE_RULES]
    rules += [
        f"len({words(folded)}) = 0",
        f"len({words(spaced)}) = 0",
        f"list_has_any({words(folded)}, {_list(W.LEGAL_ENTITIES)})",
        f"list_has_any({_pieces(spaced)}, {_list(W.META_TOKENS)})",
        f"coalesce({_pieces(spaced)}[1] IN {_quoted(W.STORES)}, false)",
        f"(list_has_any({_pieces(spaced)}, {_list(W.ADDRESS_WORDS)}) AND regexp_matches({low}, '\\d') AND NOT {price} AND NOT regexp_matches({low}, '[a-c]$'))",
        f"(regexp_matches({folded}, '{_re2(W.POSTCODE)}') AND NOT {price} AND regexp_matches({folded}, '\\s\\S*[a-z]'))",
        f"(NOT {price} AND len({words(spaced)}) < 2 AND len(list_filter({words(spaced)}, lambda w: length(w) >= 4)) = 0)",
        f"length({line}) < 4",
    ]
    return "NOT (" + " OR ".join(rules) + ")"


@_query(f"""
WITH rows AS (SELECT 'doc' AS kind, CAST(doc_id AS BIGINT) AS id, line FROM {_DOC_LINES} WHERE line <> ''
  UNION ALL SELECT 'item', CAST(item_id AS BIGINT), text FROM benchmark
  UNION ALL SELECT 'line', CAST(line_id AS BIGINT), raw_text FROM {LINES})
SELECT kind, id, count(*) FILTER (WHERE {_is_product()}) AS n_product, count(*) AS n_lines FROM rows GROUP BY kind, id""")
def line_filter(spark, d):
    """How many document, benchmark and receipt lines pass for product lines."""
    rows = _doc_lines(spark, d).where("line <> ''").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "line")
    rows = rows.unionByName(_table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("text").alias("line")))
    rows = rows.withColumn("product", X.is_product_line(F.col("line")))
    told = matching.by_text(D.frame(spark, d, D.NOISY_LINES), lambda texts: texts.select("line_id", X.is_product_line(F.col("raw_text")).alias("product")))
    rows = rows.unionByName(told.select(F.lit("line").alias("kind"), F.col("line_id").cast("long").alias("id"), F.col("raw_text").alias("line"), "product"))
    return rows.groupBy("kind", "id").agg(F.count_if("product").alias("n_product"), F.count(F.lit(1)).alias("n_lines"))


_NO_LETTERS = f"translate(w, '{W.DIGITS}', '{W.DIGITS_AS_LETTERS}')"
_READINGS = f"list_filter([w, CASE WHEN regexp_matches(w, '{_re2(W.ONE_DIGIT)}') AND NOT regexp_matches(w, '{_QUANTITY}') THEN regexp_replace(w, '\\d', '', 'g') END, CASE WHEN regexp_matches(w, '{_re2(W.DIGITS_IN_WORD)}') AND {_NO_LETTERS} <> w AND NOT regexp_matches(w, '{_QUANTITY}') THEN {_NO_LETTERS} END], lambda x: x IS NOT NULL)"
_LOW = "lower(CASE WHEN w = 'Gr' AND dessert THEN 'Grieß' ELSE w END)"
_WRITTEN = f"CASE WHEN {_LOW} NOT IN {_quoted(W.DROPPED_BRANDS + W.CERTIFICATIONS)} THEN coalesce({_cases(_LOW, W.ABBREVIATIONS)}, concat_ws(' ', CASE WHEN w = 'Gr' AND dessert THEN 'Grieß' ELSE w END, {_cases(_LOW, W.SYNONYMS)})) END"


def _near_tail(longer: int) -> str:
    """Whether the last letters of w, as many as the head s has and ``longer``, are s but for one edit."""
    return f"length(s) >= 4 AND length(w) > length(s) + {3 + longer} AND levenshtein(substr(lower(w), length(w) - length(s) - {longer} + 1), s) <= 1"


_HEAD_LENGTH = f"CASE WHEN ends_with(lower(w), s) AND length(w) > length(s) + 3 THEN length(s) WHEN {_near_tail(0)} THEN length(s) WHEN {_near_tail(-1)} THEN length(s) - 1 WHEN {_near_tail(1)} THEN length(s) + 1 END"
_SPLIT = f"CASE WHEN length(w) >= 8 THEN list_filter(list_transform({_list(W.HEAD_NOUNS)}, lambda s: {{'head': s, 'k': {_HEAD_LENGTH}}}), lambda x: x.k IS NOT NULL)[1] END"


def prepared_sql(lines: str) -> str:
    """CTEs up to ``prepared`` (line_id, raw_text, cased, lookalikes, expanded, fat, heads, raw, ascii) of a subquery (line_id, raw_text)."""
    return f"""
cased AS (SELECT line_id, raw_text, {_fat('raw_text')} AS fat, {_rewritten('raw_text', W.CASE_STEPS)} AS cased FROM {lines}),
alike AS (SELECT *, array_to_string(flatten(list_transform({_pieces(f"regexp_replace(cased, '{W.NO_WORD_SIGN}', ' ', 'g')")}, lambda w: {_READINGS})), ' ') AS lookalikes FROM cased),
parted AS (SELECT *, {_pieces(_rewritten('lookalikes', W.EXPANSION_STEPS))} AS pieces FROM alike),
sweet AS (SELECT *, len(list_filter(pieces, lambda w: lower(w) IN {_quoted(W.DESSERT_WORDS)})) > 0 AS dessert FROM parted),
expanded AS (SELECT *, coalesce(array_to_string(list_filter(list_transform(pieces, lambda w: {_WRITTEN}), lambda w: w IS NOT NULL), ' '), '') AS expanded FROM sweet),
splits AS (SELECT *, list_transform({_pieces('expanded')}, lambda w: {{'word': w, 's': {_SPLIT}}}) AS splits FROM expanded),
final AS (SELECT *, list_transform(list_filter(splits, lambda x: x.s IS NOT NULL), lambda x: x.s.head) AS heads,
  coalesce(array_to_string(list_transform(splits, lambda x: CASE WHEN x.s IS NULL THEN x.word ELSE substr(x.word, 1, length(x.word) - x.s.k) || ' ' || x.s.head END), ' '), '') AS final FROM splits),
prepared AS (SELECT line_id, raw_text, cased, lookalikes, expanded, fat, heads,
  list_filter({_tokens(_raw_form('final'))}, lambda w: NOT regexp_matches(w, '{_QUANTITY}')) AS raw, list_filter({_tokens(_ascii_form('final'))}, lambda w: NOT regexp_matches(w, '{_QUANTITY}')) AS ascii FROM final)
"""


@_query("WITH " + prepared_sql(LINES) + " SELECT line_id, lookalikes, expanded, fat, array_to_string(list_sort(list_distinct(heads)), ' ') AS heads, array_to_string(raw, ' ') AS raw, array_to_string(ascii, ' ') AS folded FROM (SELECT line_id, lookalikes, expanded, fat, heads, raw, ascii FROM prepared)")
def line_rewrites(spark, d):
    """Receipt lines as the matcher reads them: digits as letters, abbreviations written out, compounds split, both foldings."""
    joined = lambda c: F.array_join(c, " ")

    def answer(texts):
        read = matching.prepare_lines(texts).withColumn("lookalikes", X.with_lookalikes(X.split_case(F.col("raw_text")))).withColumn("expanded", X.expand_abbreviations(F.col("lookalikes")))
        return matching.cut(read.select("line_id", "lookalikes", "expanded", "fat", joined(F.array_sort("heads")).alias("heads"), joined("raw").alias("raw"), joined("ascii").alias("folded")))

    return matching.by_text(D.frame(spark, d, D.NOISY_LINES), answer).drop("raw_text")


# Candidates
_CONFUSED = D.values([(k, x) for k, others in W.CONFUSIONS.items() for x in others], "letter, other")
_LETTERS = "unnest(string_split('abcdefghijklmnopqrstuvwxyz', ''))"


def _grams(rows: str, columns: str, token: str, n: int) -> str:
    """A subquery (columns, gram): substrings of length n, or the whole of a shorter token."""
    return f"(SELECT {columns}, substr({token}, CAST(i AS INT), {n}) AS gram FROM (SELECT *, unnest(range(1, greatest(length({token}) - {n - 2}, 2))) AS i FROM {rows}))"


CANDIDATES = f"""
asked AS (SELECT line_id, i - 1 AS pos, u[i] AS q FROM (SELECT line_id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT line_id, {_ordered('list_concat(raw, ascii)')} AS u FROM prepared))),
stemmed AS (SELECT *, {_STEM.format('q')} AS qs FROM asked),
st AS (SELECT DISTINCT id, {_STEM.format('token')} AS stem FROM idx),
keys AS (SELECT DISTINCT token FROM idx),
by5 AS (SELECT DISTINCT line_id, pos, q, token FROM {_grams('(SELECT * FROM asked WHERE length(q) >= 4)', 'line_id, pos, q', 'q', 5)} a JOIN {_grams('keys', 'token', 'token', 5)} b USING (gram) WHERE contains(token, q) OR contains(q, token) OR abs(length(token) - length(q)) <= 2),
rest AS (SELECT * FROM asked WHERE length(q) BETWEEN 5 AND 8 AND NOT EXISTS (SELECT 1 FROM by5 WHERE by5.line_id = asked.line_id AND by5.pos = asked.pos)),
by4 AS (SELECT DISTINCT line_id, pos, q, token FROM {_grams('rest', 'line_id, pos, q', 'q', 4)} a JOIN {_grams('(SELECT * FROM keys WHERE length(token) BETWEEN 4 AND 10)', 'token', 'token', 4)} b USING (gram) WHERE abs(length(token) - length(q)) <= 2),
direct AS (
  SELECT line_id, pos, q, id, 2 AS w, true AS strong FROM asked JOIN idx ON idx.token = q
  UNION ALL SELECT line_id, pos, q, id, 2, true FROM (SELECT *, CASE WHEN qs IN (SELECT stem FROM st) THEN qs ELSE q END AS k FROM stemmed WHERE qs <> q) JOIN st ON st.stem = k
  UNION ALL SELECT line_id, pos, q, id, 1, false FROM (SELECT * FROM by5 UNION ALL SELECT * FROM by4) g JOIN idx USING (token)),
firsts AS (SELECT DISTINCT line_id, pos FROM (SELECT line_id, id, min(pos) AS pos FROM direct GROUP BY line_id, id)),
alone AS (SELECT *, length(q) AS n FROM asked WHERE length(q) BETWEEN 5 AND 10 AND q NOT IN (SELECT token FROM keys) AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.line_id = asked.line_id AND f.pos = asked.pos)),
placed AS (SELECT *, CAST(unnest(range(1, n + 2)) AS INT) AS i FROM alone),
made AS (
  SELECT line_id, pos, q, 1 AS level, substr(q, 1, i - 1) || other || substr(q, i + 1) AS variant FROM placed JOIN {_CONFUSED} ON letter = substr(q, i, 1) WHERE i <= n
  UNION ALL SELECT line_id, pos, q, 2, substr(q, 1, i - 1) || substr(q, i + 1) FROM placed WHERE i <= n
  UNION ALL SELECT line_id, pos, q, 3, substr(q, 1, i - 1) || a || substr(q, i) FROM (SELECT *, {_LETTERS} AS a FROM placed WHERE n <= 9)),
edited AS (
  SELECT line_id, pos, q, level, id, variant, 0 AS kind FROM made JOIN idx ON idx.token = variant
  UNION SELECT line_id, pos, q, level, id, variant, 1 FROM (SELECT *, {_STEM.format('variant')} AS vs FROM made) JOIN st ON st.stem = vs),
hits AS (
  SELECT * FROM direct
  UNION ALL SELECT line_id, pos, q, id, 2, false FROM (SELECT *, min(level) OVER (PARTITION BY line_id, pos) AS lowest FROM edited) WHERE level = lowest),
counted AS (SELECT line_id, id, CAST(sum(w) AS BIGINT) AS hits, min(pos) AS first_pos, bool_or(strong AND q NOT IN {_quoted(W.DESCRIPTORS)}) AS recognized FROM hits GROUP BY line_id, id),
best AS (SELECT line_id, id, hits, row_ord FROM (SELECT c.*, f.row_ord, row_number() OVER (PARTITION BY line_id ORDER BY c.hits DESC, c.first_pos, f.row_ord) AS place
  FROM counted c JOIN {FOODS} f USING (id) WHERE line_id IN (SELECT line_id FROM counted WHERE recognized)) WHERE place <= {matching.MAX_CANDIDATES})
"""


@_query("WITH " + prepared_sql(LINES) + ", " + _TOKEN_SQL.strip() + ", " + CANDIDATES + " SELECT line_id, id, hits, row_ord FROM best")
def line_candidates(spark, d):
    """The 120 foods at most that have most hits with a line by tokens, stems, grams and edit variants."""
    answer = lambda texts: matching.best_candidates(matching.cut(matching.prepare_lines(texts)), _foods(spark, d))
    return matching.by_text(D.frame(spark, d, D.NOISY_LINES), answer).select("line_id", "id", F.col("hits").cast("long").alias("hits"), "row_ord")


# Scores: o a line's token, n a food's
_SHORT, _TALL = "least(length(o), length(n))", "greatest(length(o), length(n))"
_RATIO = f"({_SHORT}::DOUBLE / {_TALL})"
_SO, _SN = _STEM.format("o"), _STEM.format("n")
_SPELLED = f"(1e0 - levenshtein(o, n)::DOUBLE / {_TALL})"
_STEMS = f"(1e0 - levenshtein({_SO}, {_SN})::DOUBLE / greatest(length({_SO}), length({_SN})))"
_LIFTED = f"CASE WHEN {_SPELLED} > 0.45e0 AND {_SPELLED} <= 0.75e0 AND ({_SO} <> o OR {_SN} <> n) THEN greatest({_SPELLED}, {_STEMS}) ELSE {_SPELLED} END"
_EDGE = " OR ".join(f"{side}_with(n, substr(o, {at}, 4))" for at in ("1", "length(o) - 3") for side in ("starts", "ends"))
_SIMILARITY = f"""CASE WHEN {_SHORT} < 4 AND o <> n THEN 0e0 WHEN o = n THEN 1e0
  WHEN starts_with(n, o) OR starts_with(o, n) THEN CASE WHEN {_SO} = {_SN} THEN 0.97e0 ELSE 0.5e0 + {_RATIO} * 0.35e0 END
  WHEN {_LIFTED} > 0.7e0 THEN {_LIFTED}
  WHEN {_SHORT} >= 5 AND (contains(n, o) OR contains(o, n)) THEN 0.4e0 + {_RATIO} * 0.35e0 WHEN {_EDGE} THEN 0.6e0 ELSE 0e0 END"""
_CORE = "regexp_matches({0}, '(?i)" + W.CORE_NOUN_PATTERN + "')"
_BONUS = f"CASE WHEN NOT ({_CORE.format('o')} OR {_CORE.format('n')}) THEN 0e0 WHEN o = n THEN 0.55e0 WHEN {_STEMS} > 0.75e0 THEN 0.5e0 ELSE 0e0 END"
_NEAR = "n = o OR 1e0 - levenshtein(o, n)::DOUBLE / greatest(length(o), length(n)) > 0.6e0 OR (length(n) >= 4 AND (contains(n, o) OR contains(o, n)))"


def _only_food(parts: list[str]) -> str:
    return f"(regexp_matches(array_to_string(ns, ' '), '{_alt(parts)}') AND NOT regexp_matches(array_to_string(os, ' '), '{_alt(parts)}'))"


def _has_form(tokens: str) -> str:
    return f"(len(list_filter({tokens}, lambda t: t = 'dough' OR (ends_with(t, 'teig') AND NOT contains(t, 'waren')) OR (length(t) >= 6 AND ends_with(t, 'eis') AND NOT ends_with(t, 'reis')))) > 0)"


_PARENS = "array_to_string(regexp_extract_all(coalesce({0}, ''), '\\(([^)]*)\\)', 1), ' ')"
_ADDITIVE = r"(?i)\bE[-\s]?\d{3}\b|additive|chemical|curing salt"

#: Scores of the candidates' names: pairs of token lists are told apart, and each pair of tokens is compared once.
SCORED = f"""
named AS (SELECT id, name, {', '.join(f"{form(c)} AS {c}_{kind}" for c in ('name', 'name_de') for kind, form in (('raw', _raw_form), ('ascii', _ascii_form)))},
  list_concat({_tokens(_raw_form(_PARENS.format('name')))}, {_tokens(_ascii_form(_PARENS.format('name')))}, {_tokens(_raw_form(_PARENS.format('name_de')))}, {_tokens(_ascii_form(_PARENS.format('name_de')))}) AS parens, name_de FROM {FOODS}),
tries AS ({' UNION ALL '.join(f"SELECT b.line_id, b.id, b.hits, b.row_ord, p.heads, p.fat, n.parens, n.name AS english_name, p.{form} AS os, {_tokens(f'n.{c}_{form}')} AS ns, n.{c}_{form} AS whole_name, n.{c} AS tested_name, {str(c == 'name').lower()} AS english FROM best b JOIN prepared p USING (line_id) JOIN named n USING (id) WHERE n.{c} IS NOT NULL AND len(p.{form}) > 0" + (f" AND (p.ascii <> p.raw OR n.{c}_ascii <> n.{c}_raw)" if form == 'ascii' else '') for c in ('name_de', 'name') for form in ('raw', 'ascii'))}),
pairs AS (SELECT DISTINCT o, n FROM (SELECT DISTINCT o, ns FROM (SELECT unnest(os) AS o, ns FROM (SELECT DISTINCT os, ns FROM tries))), unnest(ns) AS u(n)),
compared AS (SELECT o, n, {_SIMILARITY} AS sim, {_BONUS} AS bonus, {_NEAR} AS near FROM pairs),
lists AS (SELECT row_number() OVER () AS list_no, * FROM (SELECT DISTINCT os, ns, heads, parens FROM tries)),
os_of AS (SELECT list_no, unnest(range(1, len(os) + 1)) AS i, unnest(os) AS o FROM lists),
ns_of AS (SELECT list_no, unnest(range(1, len(ns) + 1)) AS j, unnest(ns) AS n FROM lists),
met AS (SELECT * FROM os_of JOIN ns_of USING (list_no) JOIN compared USING (o, n)),
by_o AS (SELECT list_no, i, o, coalesce(max(sim), 0e0) AS best, coalesce(max(sim) FILTER (WHERE j = 1), NULL) AS lead FROM os_of LEFT JOIN met USING (list_no, i, o) GROUP BY list_no, i, o),
cored AS (SELECT b.*, list_contains(l.heads, o) AS is_head, min(i) FILTER (WHERE {_CORE.format('o')} OR list_contains(l.heads, o)) OVER (PARTITION BY list_no) AS core_at FROM by_o b JOIN lists l USING (list_no)),
weighed AS (SELECT *, CASE WHEN o IN {_quoted(W.DESCRIPTORS)} THEN 0e0 WHEN i = core_at THEN CASE WHEN is_head THEN 5e0 ELSE 3e0 END * CASE WHEN i = 1 THEN 1.5e0 ELSE 1e0 END ELSE 1e0 END AS w FROM cored),
lines_side AS (SELECT list_no, coalesce(sum(best * w ORDER BY i) / nullif(sum(w ORDER BY i), 0), 0e0) + CASE WHEN bool_or(i = core_at AND best > 0.8e0 AND lead >= best) THEN 0.08e0 ELSE 0e0 END AS base FROM weighed GROUP BY list_no),
by_n AS (SELECT n.list_no, j, n, CASE WHEN {_CORE.format('n')} THEN 3e0 ELSE 1e0 END AS w, coalesce(bool_or(near), false) AS hit FROM ns_of n LEFT JOIN met USING (list_no, j, n) JOIN lists l ON l.list_no = n.list_no
  WHERE n NOT IN {_quoted(W.IMPLICIT_QUALIFIERS)} AND NOT list_contains(l.parens, n) GROUP BY n.list_no, j, n),
foods_side AS (SELECT list_no, sum(CASE WHEN hit THEN w ELSE 0e0 END ORDER BY j) / nullif(sum(w ORDER BY j), 0) AS share, count(*) FILTER (WHERE NOT hit) AS unmatched FROM by_n GROUP BY list_no),
floors AS (SELECT list_no, max(bonus) AS floor FROM met GROUP BY list_no),
mixed AS (SELECT l.*, array_to_string(os, ' ') AS line, coalesce(unmatched, 0) AS unmatched, coalesce(floor, 0e0) AS floor, base * 0.65e0 + coalesce(share, 1e0) * 0.35e0 AS mixed,
  CASE WHEN {_only_food(W.PLANT_WORDS)} THEN 0.6e0 ELSE 1e0 END AS plant, CASE WHEN {_only_food(W.DIET_WORDS)} THEN 0.7e0 ELSE 1e0 END AS diet,
  CASE WHEN {_has_form('ns')} AND NOT {_has_form('os')} THEN 0.65e0 ELSE 1e0 END AS form, CASE WHEN regexp_matches(array_to_string(ns, ' '), '{_alt(W.COMPOSITE_WORDS)}') THEN 0.8e0 ELSE 1e0 END AS composite
  FROM lists l JOIN lines_side USING (list_no) LEFT JOIN foods_side USING (list_no) LEFT JOIN floors USING (list_no)),
whole AS (SELECT t.*, m.mixed, m.unmatched, m.floor, CASE WHEN t.english THEN 0.85e0 ELSE 1e0 END * plant * diet * form * composite AS factor, 1e0 - levenshtein(m.line, t.whole_name)::DOUBLE / greatest(length(m.line), length(t.whole_name)) AS whole
  FROM tries t JOIN mixed m ON m.os = t.os AND m.ns = t.ns AND m.heads = t.heads AND m.parens = t.parens),
damped AS (SELECT *, CASE WHEN whole > mixed AND whole > 0.6e0 AND mixed > 0.1e0 THEN whole ELSE mixed END * factor AS damped, {_fat('tested_name')} AS food_fat FROM whole),
scored AS (SELECT line_id, id, row_ord, hits, unmatched,
  least(0.95e0, CASE WHEN regexp_matches(english_name, '{_ADDITIVE}') AND damped < 0.95e0 THEN damped * 0.4e0 ELSE damped END + floor * 0.2e0)
  - CASE WHEN fat IS NULL THEN 0e0 WHEN food_fat IS NOT NULL THEN abs(fat - food_fat) * 0.01e0 ELSE 0.05e0 END AS confidence FROM damped),
banded AS (SELECT *, max(confidence) OVER (PARTITION BY line_id) AS top FROM scored),
matched AS (SELECT line_id, id AS food_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY unmatched, confidence DESC, hits DESC, row_ord) AS place FROM banded WHERE confidence >= top - {matching.BAND}e0) WHERE place = 1)
"""


def fuzzy_sql(lines: str) -> str:
    """CTEs up to ``matched`` (line_id, food_id, confidence) for the product lines of a subquery (line_id, raw_text)."""
    kept = f"(SELECT line_id, raw_text FROM {lines} WHERE {_is_product('raw_text')})"
    return prepared_sql(kept) + ", " + _TOKEN_SQL.strip() + ", " + CANDIDATES + ", " + SCORED


@_query("WITH " + fuzzy_sql(LINES) + f" SELECT line_id, raw_text, food_id, round(coalesce(confidence, 0e0) + 1e-9, 4) AS confidence FROM {LINES} LEFT JOIN matched USING (line_id) WHERE {_is_product('raw_text')}")
def fuzzy_match_top1(spark, d):
    """Each receipt line with its best food."""
    found = matching.parse_lines(D.frame(spark, d, D.NOISY_LINES), _foods(spark, d))
    return found.select("line_id", "raw_text", "food_id", _r(F.col("confidence") + 1e-9).alias("confidence"))


# Tiers
def dictionaries(spark, d) -> dict:
    """Overrides, whole lines, brands and known non-matches, derived from the catalog and its lines; each key once."""
    foods, lines = _foods(spark, d), D.frame(spark, d, D.NOISY_LINES)
    keyed = matching.by_text(lines.where("cast(line_id as long) % 7 = 0"), lambda texts: texts.select("line_id", X.override_key(F.col("raw_text")).alias("key")))
    made = {
        "overrides": keyed.groupBy("key").agg(F.min_by("line_id", F.col("line_id").cast("long")).alias("food_id")),
        "dictionary": foods.where("row_ord % 6 = 0").select(F.lower("name").alias("key"), F.col("name").alias("food_name")).distinct(),
        "brands": foods.where("row_ord % 5 = 4 and name_de is not null").select(F.lower("name_de").alias("key"), F.col("name_de").alias("food_name")).distinct(),
        "non_matches": foods.where("row_ord % 12 = 0").select(F.lower("name").alias("key")).distinct(),
    }
    return {name: matching.cut(table) for name, table in made.items()}  # sizes as they are, not as the catalog's file has them


def _override_key(x: str) -> str:
    return f"trim(regexp_replace({_rewritten(f'lower({x})', W.OVERRIDE_STEPS)}, '\\s+', ' ', 'g'))"


_ESCAPED = "regexp_escape(b.key)"
TIERS = f"""
told AS (SELECT line_id, raw_text, lower(trim(raw_text)) AS low, {_override_key('raw_text')} AS okey FROM {LINES}),
overrides AS (SELECT okey, arg_min(line_id, CAST(line_id AS BIGINT)) AS f_over FROM told WHERE CAST(line_id AS BIGINT) % 7 = 0 GROUP BY okey),
food_names AS (SELECT food_name, arg_min(id, row_ord) AS id FROM (SELECT row_ord, id, name AS food_name FROM {FOODS} UNION ALL SELECT row_ord, id, name_de FROM {FOODS} WHERE name_de IS NOT NULL) GROUP BY food_name),
exact AS (SELECT DISTINCT lower(name) AS low, n.id AS f_exact FROM {FOODS} f JOIN food_names n ON n.food_name = f.name WHERE f.row_ord % 6 = 0),
brands AS (SELECT DISTINCT lower(name_de) AS key, name_de AS food_name FROM {FOODS} WHERE row_ord % 5 = 4 AND name_de IS NOT NULL),
embedded AS (SELECT line_id, b.key, b.food_name, regexp_matches(low, '(^|[^a-zäöüß])' || {_ESCAPED} || '($|[^a-zäöüß])') AS whole FROM told JOIN brands b ON contains(low, b.key)
  WHERE contains(regexp_replace(low, {_ESCAPED} || '[a-zäöüß]*({_alt(W.PROCESSED_SUFFIXES)})($|[^a-zäöüß])', '#\\2', 'g'), b.key)),
branded AS (SELECT line_id, n.id AS f_brand, ends_with(e.food_name, ' roh') AS is_raw FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY whole DESC, length(key) DESC, key) AS place FROM embedded) e JOIN food_names n USING (food_name) WHERE place = 1),
fuzzy AS (SELECT line_id, food_id AS f_fuzzy, coalesce(confidence, 0e0) AS c_fuzzy FROM told LEFT JOIN matched USING (line_id) WHERE {_is_product('raw_text')}),
sourced AS (SELECT *, CASE WHEN f_over IS NOT NULL THEN 'override' WHEN f_exact IS NOT NULL THEN 'exact' WHEN f_brand IS NOT NULL AND NOT coalesce(is_raw AND c_fuzzy >= 0.72e0, false) THEN 'brand' WHEN c_fuzzy IS NOT NULL THEN 'bls' END AS source
  FROM told LEFT JOIN (SELECT * FROM overrides WHERE f_over IN (SELECT id FROM {FOODS})) USING (okey) LEFT JOIN exact USING (low) LEFT JOIN branded USING (line_id) LEFT JOIN fuzzy USING (line_id)),
resolved AS (SELECT line_id, raw_text, source, source <> 'override' AND low IN (SELECT lower(name) FROM {FOODS} WHERE row_ord % 12 = 0) AS barred,
  CASE source WHEN 'override' THEN f_over WHEN 'exact' THEN f_exact WHEN 'brand' THEN f_brand ELSE f_fuzzy END AS food_id,
  CASE source WHEN 'override' THEN 1e0 WHEN 'exact' THEN 0.99e0 WHEN 'brand' THEN 0.95e0 ELSE c_fuzzy END AS confidence FROM sourced WHERE source IS NOT NULL)
"""


@_query("WITH " + fuzzy_sql(LINES) + ", " + TIERS + " SELECT line_id, CASE WHEN NOT barred THEN food_id END AS food_id, CASE WHEN barred THEN 0e0 ELSE round(confidence + 1e-9, 4) END AS confidence, source FROM resolved")
def tier_resolve(spark, d):
    """Receipt lines through all tiers: override, exact, brand, fuzzy, and known non-matches."""
    found = matching.resolve_lines(D.frame(spark, d, D.NOISY_LINES), _foods(spark, d), **dictionaries(spark, d))
    return found.select("line_id", "food_id", _r(F.col("confidence") + 1e-9).alias("confidence"), "source")
