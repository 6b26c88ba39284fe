"""Fill-in-middle and quality rules against plain Python, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import fill_in_middle as fim, quality_rules as rules

DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n\t", "a", "é", "\x01", "\x02", "\x02\x03", "\x02\x04\x01 b\x02", "one <P> two", "<S", "x<M>", "<M<P", "tab\tand \U0001f600 face", "ab12cd, ef\nGH", "word " * 4000, "ÀÁ mixed ß 漢字 end"]


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    if h[3] % 100 < 20:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 12)] + [(None, "no id here"), (3, "repeated row"), (3, "repeated row")]
    table = spark.createDataFrame(rows, DOCS).withColumn("own", F.lit(1)).withColumn("form", F.lit("clash"))
    made = fim.fill_in_middle(table)
    assert made.columns == ["doc_id", "text", "own", *fim.OUTPUTS]
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = Counter((i, t, *plain_fim(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    made = fim.fill_in_middle(spark.createDataFrame([], DOCS))
    assert made.count() == 0 and "Python" not in made._jdf.queryExecution().executedPlan().toString()


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain_measures(text):
    w = words_of(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def grams(text):
    h = [zlib.crc32(w.encode()) for w in words_of(text)]
    return [x % rules.BUCKETS for x in h] + [(a * 1_000_003 + b) % rules.BUCKETS for a, b in zip(h, h[1:], strict=False)]


def plain_quality(rows, trusted, least):
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i in trusted for g in grams(t))
    all_raw, all_target, prior = raw.total(), target.total(), rules.PRIOR * rules.BUCKETS
    ratio = {g: round(1e6 * math.log((target[g] * all_raw / raw[g] + prior) / (all_target + prior))) for g in raw}
    out = []
    for i, t in rows:
        m, g = plain_measures(t), grams(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        out.append((i, *m, failed, not failed and sum(ratio[x] for x in g) >= least * len(g)))
    return out


TEXTS = [*ODD, "a b c a b c", "a a a a", "x y z " * 30, "# one\n# one\n\n\n \nother <b>|$%&* line\n# one", " ".join(f"w{i}" for i in range(80)), " ".join(f"W{i}!!" for i in range(90)), " ".join(f"w{i % 40}" for i in range(120))]


@pytest.mark.parametrize("least", [-60_000, 0, 500])
def test_quality_rules_equal_plain_python(spark, least):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[-3]), (40, TEXTS[-3]), (40, TEXTS[-3]), (41, TEXTS[-2])]
    labels = spark.createDataFrame([(22, 1, 0), (40, 1, 0), (41, 0, 0), (41, 1, 0), (23, 1, 1), (24, None, None), (None, 1, 0), (22, 1, None)], "doc_id long, quality int, toxic int")
    trusted = rules.trusted_ids(labels)
    assert {r.trusted_id for r in trusted.collect()} == {22, 40}
    table = spark.createDataFrame(rows, DOCS).withColumn("own", F.lit(1)).withColumn("kept", F.lit("clash")).withColumn("keys", F.lit("mine"))
    made = rules.judge_quality(table, trusted, least_score=least)
    assert made.columns == ["doc_id", "text", "own", "keys", *rules.OUTPUTS]
    got = Counter((r.doc_id, *(r[c] for c in rules.MEASURES), r.kept) for r in made.collect())
    want = plain_quality(rows, {22, 40}, least)
    assert got == Counter(want) and {w[-1] for w in want} == {True, False}


def test_windows_of_one_hash_are_told_apart(spark):
    """Keys whose hashes say that windows 0 and 3 are equal, which they are not, while 0 and 6 are."""
    words = "a b c d e f a b c".split()
    key = lambda h, i: (h << 24) | i
    keys = sorted([key(5, 0), key(5, 3), key(5, 6)])
    row = spark.createDataFrame([(words, keys)], "words array<string>, keys array<long>")
    got = row.select(rules.repeated_starts(F.col("words"), F.col("keys")).alias("s"), rules.repeated_starts_by_text(F.col("words")).alias("t")).first()
    assert -1 in got.s and sorted(set(got.t)) == [0, 6]


def test_quality_rules_without_rows_or_trust(spark):
    none = spark.createDataFrame([], "trusted_id long")
    assert rules.judge_quality(spark.createDataFrame([], DOCS), none).count() == 0
    got = rules.judge_quality(spark.createDataFrame([(1, TEXTS[-3]), (2, None)], DOCS), none)
    assert [(r.doc_id, r.kept, r.score) for r in got.orderBy("doc_id").collect()] == [(1, True, 0.0), (2, False, None)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
