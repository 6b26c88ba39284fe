"""Operators on small tables: brute-force counterparts and edge cases."""

import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import ann, decontaminate, html_text, language_id, lm_score, near_dedup, packing, toxicity, url_filter, warc
from larder.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i}" for i in range(60))


def docs(spark, texts, first=0):
    return spark.createDataFrame([(None if t == "NOID" else first + i, "a b c d e f" if t == "NOID" else t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)


# near-duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "   ", "One two", "one TWO", "one two three", BASE, BASE.upper(), BASE + " tail"]
    base = BASE.split()
    for _ in range(60):
        w = list(base)
        for k in rng.choice(60, rng.integers(1, 5), replace=False):
            w[k] = f"x{rng.integers(1000)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{rng.integers(9999)}" for _ in range(30)) for _ in range(20)]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    want, sizes = brute_components(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_near_dedup_edges(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = docs(spark, ["a b c d e f", "NOID", "a b c d e f"]).unionByName(docs(spark, ["a b c d e f"]))
    got = near_dedup.near_duplicates(rows.withColumn("component_id", F.lit("clash")).withColumn("s0", F.lit(1))).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(0, 0, True), (0, 0, True), (2, 0, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(0, False)]


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    a, b = BASE, " ".join(f"other{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, "unlike all the others here"), (4, a + " more")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True)]
    assert len({r.group_id for r in got}) == 3


def test_near_dedup_of_a_long_text_and_other_shares(spark):
    rng = np.random.default_rng(4)
    long = [f"t{k}" for k in rng.integers(0, 10**6, 60_000)]
    near = list(long)
    for k in range(0, 60_000, 40):
        near[k] = "changed"
    half = BASE.split()
    half[::12] = ["z"] * 5  # five words apart: 5 * 5 of 56 shingles, similarity 0.38
    table = docs(spark, [" ".join(long), " ".join(near), BASE, " ".join(half)])
    assert [r.component_id for r in near_dedup.near_duplicates(table).orderBy("doc_id").collect()] == [0, 0, 2, 3]
    assert [r.component_id for r in near_dedup.near_duplicates(table, share=35).orderBy("doc_id").collect()] == [0, 0, 2, 2]
    assert [r.component_id for r in near_dedup.near_duplicates(table, share=90).orderBy("doc_id").collect()] == [0, 1, 2, 3]


def test_near_dedup_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(150):  # one common passage, tails of their own: many members of one bucket, several components
        tail = [f"x{rng.integers(12)}" for _ in range(20)]
        texts.append(" ".join(BASE.split() + tail))
    want, _ = brute_components(texts)
    assert len(set(want)) > 1
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_BLOCK", 16)
    got = near_dedup.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


@pytest.mark.parametrize("share", [35, 60, 75, 90])
def test_signature_keys_guarantee_the_distance(spark, share):
    rng = np.random.default_rng(0)
    errors = near_dedup.chunk_errors(share)
    rows = []
    for i in range(60):
        symbols = rng.integers(0, 1 << near_dedup.SYMBOL_BITS, (2, near_dedup.SYMBOLS))
        same = np.ones(near_dedup.SYMBOLS, bool)
        same[rng.choice(near_dedup.SYMBOLS, near_dedup.max_distance(errors), replace=False)] = False
        symbols[1, same] = symbols[0, same]
        for side in (0, 1):
            lanes = symbols[side].reshape(near_dedup.CHUNKS, near_dedup.LANES)
            rows.append((2 * i + side, *(int(sum(int(x) << (near_dedup.SYMBOL_BITS * k) for k, x in enumerate(chunk))) for chunk in lanes)))
    table = spark.createDataFrame(rows, "cid long, " + ", ".join(f"{c} long" for c in near_dedup.SIG))
    keys = near_dedup.signature_keys(table, errors)
    met = keys.groupBy("key").agg(F.collect_set("cid").alias("ids")).where("size(ids) > 1").select(F.explode("ids").alias("cid")).distinct()
    assert met.count() == 120


def test_the_bitmap_bound_keeps_every_link(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(80):
        n, pool = int(rng.integers(1, 3000)), rng.integers(0, 1 << 62, 4000).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n - n // 8], pool[n : n + int(rng.integers(0, 1 + n // 8))]]))
        both = len(np.intersect1d(a, b))
        rows.append((i, len(a), near_dedup.bitmap(a).tolist(), len(b), near_dedup.bitmap(b).tolist(), 100 * both >= 75 * (len(a) + len(b) - both)))
    table = spark.createDataFrame(rows, "i long, n long, x array<long>, m long, y array<long>, link boolean")
    left, right = table.selectExpr("i", "n as n_shingles", "x as bits", "link").alias("l"), table.selectExpr("i", "m as n_shingles", "y as bits").alias("r")
    judged = left.join(right, "i").select("link", near_dedup.may_overlap(75).alias("kept")).collect()
    assert all(r.kept for r in judged if r.link) and any(r.link for r in judged)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (50, 45), (45, 41)]
    with Scratch(spark) as work:
        got = {r.cid: r.component for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long"), work).collect()}
        assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in (41, 45, 50)} == {41}
        assert near_dedup.components(spark.createDataFrame([], "a long, b long"), work).count() == 0


# decontamination


def brute_hits(text, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(13, len(x))
        for i in range(len(x) - n + 1 if x else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(item))
    return len(w), len(hit), ",".join(sorted(ids))


def test_decontamination_equals_brute_force(spark):
    item = " ".join(f"b{i}" for i in range(20))
    items = [(1, item), (10, "short item"), (2, item.upper()), (3, None), (4, "..."), (5, "one"), (6, "b0 b1 b0 b1 b0 b1 b0 b1 b0 b1 b0 b1 b0 b1 b0")]
    texts = [None, "", "---", item, "x " * 50 + item[10:], "Short, ITEM! and one more", "b0 b1 " * 30, "é" + item, item + " " + "y " * 400, "one"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.SLICE_CHARS, 40):  # one slice, and several
        got = {r.doc_id: r for r in decontaminate.mark_contamination(docs(spark, texts).withColumn("n_hit", F.lit(7)), bench, slice_chars=limit).collect()}
        for i, t in enumerate(texts):
            n, hit, ids = brute_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].items_sha256) == (n, hit, hashlib.sha256(ids.encode()).hexdigest()), (i, limit)
            assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
    empty = decontaminate.mark_contamination(docs(spark, ["a b"]), bench.limit(0)).first()
    assert (empty.n_hit, empty.contaminated) == (0, False)
    assert decontaminate.mark_contamination(docs(spark, []), bench).count() == 0


# packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "hello", "hello", "long text " * 3000, "ümläut 😀 <|endoftext|> x", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|>\n<|endoftext|> <|endoftex|>", "x " * 150_000 + "<|endoftext|> y z " + "w " * 150_000, *(f"doc {i} " * (i % 37) for i in range(80))]
    got = packing.pack_documents(docs(spark, texts), with_ids=True).toPandas()
    slow = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate(texts):
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        rows = got[got.doc_id == i].sort_values("start")
        assert [x for part in rows.ids for x in part] == ids
        assert (rows.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(rows.ids, rows.ids_crc32, strict=True))
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 1024).all()
    assert (got.sort_values(["sequence_id", "offset"]).offset == by.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length).all()
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_cutting_stock_holds_the_demand():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 20_000):
        sizes, counts = np.unique(rng.integers(1, 129, n), return_counts=True)
        demand = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        plan = packing.cutting_stock(demand, 128)
        held = defaultdict(int)
        for times, pattern in plan:
            assert sum(s * k for s, k in pattern.items()) <= 128
            for s, k in pattern.items():
                held[s] += times * k
        assert dict(held) == demand
        assert sum(t for t, _ in plan) <= 1.1 * sum(s * k for s, k in demand.items()) / 128 + 2
    assert packing.cutting_stock({}, 128) == []


def test_stretches_keep_the_ids():
    text = "some words and\nlines here " * 30_000
    parts = packing.stretches(text, 10_000)
    assert "".join(parts) == text and len(parts) > 10
    encoder = packing.Encoder(packing.default_tokenizer())
    assert np.concatenate([encoder.ids(p) for p in parts]).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids


# url filter


def test_url_filter(spark):
    urls = ["http://net/x", "http://a.NET/", "http://a.net", "https://b.example.net/en/1", "https://b.example.net/de/1", "http://example.com/de/?q", "http://xexample.com/de/", "http://q.org/fr/a/b#x", "no scheme", None, "http://a b.net/y", "http://user@x.net:80/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, host string")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "block"), ("x.org/a*z", "block")], "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got[0] == ("net", "/x", "net/", "block") and got[1] == ("a.net", "/", "net/", "block") and got[2] == ("a.net", "", None, "allow")
    assert got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("net/", "block") and got[5][2:] == ("example.com/de/", "block")
    assert got[6][2:] == (None, "allow") and got[7] == ("q.org", "/fr/a/b", "org/fr/", "allow") and got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == ("net/", "block") and got[11][2:] == (None, "allow")
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 13
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "net/" + "x/" * 50_000)], "page_id long, url string")
    assert url_filter.judge_urls(long, rules).first().rule == "net/"
    wild = spark.createDataFrame([(1, "http://x.org/abcz/")], "page_id long, url string")
    assert url_filter.judge_urls(wild, rules).first().rule == "x.org/a*z"


# archives


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 300
    rows = [(5, "u5", long), (3, "u3\nbroken", long), (9, None, long), (1, "a", "short"), (2, "b", "short"), (4, "c", None), (None, "d", long), (7, "e", "é" * 90), (7, "f", "é" * 90), (7, "e", "é" * 90), *((100 + i, f"v{i}", f"<html>{i} " + "body " * 40) for i in range(40))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages, str(tmp_path / "w"), archives=3)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert by[3][0].record_type == "response" and bytes(by[3][0].payload).decode() == long
    assert [(by[i][0].record_type, by[i][0].refers_to) for i in (5, 9, None)] == [("revisit", 3)] * 3
    assert by[5][0].payload_bytes == len(long) and by[5][0].payload_digest == hashlib.sha256(long.encode()).hexdigest()
    assert {by[i][0].record_type for i in (1, 2, 4)} == {"response"} and by[4][0].payload_bytes == 0
    assert sorted((r.record_type, r.refers_to) for r in by[7]) == [("response", None), ("revisit", 7), ("revisit", 7)]
    assert sorted(r.url for r in by[7] if r.record_type == "response") == ["e"]
    huge = spark.createDataFrame([(i, "u", str(i) * 3_000_000) for i in (1, 2)], "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    back = warc.read_archives(spark, warc.write_archives(huge, str(tmp_path / "h"))).orderBy("page_id").collect()
    assert [(r.payload_bytes, r.payload_digest) for r in back] == [(3_000_000, hashlib.sha256(str(i).encode() * 3_000_000).hexdigest()) for i in (1, 2)]
    import zstandard

    file = next(iter({r.file for r in got})).removeprefix("file:")
    raw = open(file, "rb").read()
    if raw[:4] == (0x184D2A5D).to_bytes(4, "little"):  # records can be read alone with the leading dictionary
        one = next(r for r in got if r.file.endswith(file))
        size = int.from_bytes(raw[4:8], "little")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        assert reader.decompressobj().decompress(raw[one.offset : one.offset + one.length]).startswith(b"WARC/1.1")
    empty = warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, empty).count() == 0


# nearest neighbours


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[200:500] = x[200]  # one vector that a third of the rows share
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0], 0), (2080, [None] * 16, 0), (None, x[3].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = ann.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    assert got.query_id.nunique() == 45 and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = np.einsum("d,nd->n", x[q], x)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        g = g.sort_values("rank")
        hits += len(set(want) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id])
    assert hits / (45 * 20) >= 0.9
    again = ann.nearest(table, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id").collect()
    monkeypatch.setattr(ann, "BLOCK", 256)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "GROUP", 200)
    split = ann.nearest(table, F.col("vec_id") % 20 == 0, shortlist=256).toPandas()
    assert len(split) == len(again)
    for q, g in split.groupby("query_id"):  # shortlists as large as blocks make the search exact
        s = np.einsum("d,nd->n", x[q], x)
        s[q] = -np.inf
        assert g.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(900), -s))[:20].tolist()
    few = ann.nearest(table.limit(4), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in few] and len(few) == 3
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


# language identification


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(5)
    parts = {"aa": ["the", "and", "shen", "ing", "tion"], "bb": ["der", "ung", "schö", "keit", "über"], "cc": ["los", "ción", "mente", "que", "ñan"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(40)) + ".", lang, "s", 1))
    return rows


def test_language_id(spark, spoken):
    extra = [(1000, None, "aa", "s", 1), (1001, "123 !!", "bb", "s", 1), (1002, "", None, "s", 1), (1003, "schö keit über der ung " * 3000, None, "s", 1)]
    table = spark.createDataFrame(spoken + extra, DOCS)
    model = language_id.fit(table, learn=~language_id.held_out())
    got = {r.doc_id: r for r in language_id.identify(table.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in spoken)
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[1003].lang_pred == "bb" and not got[1003].rejected
    assert sum(r.rejected for i, r in got.items() if i < 1000) == 0
    none = language_id.fit(table.withColumn("lang", F.lit(None).cast("string")), learn=F.lit(True))
    assert language_id.identify(table, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(table.limit(0), model).count() == 0


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def plain_kneser_ney(texts, order=4):
    """log P(symbol | up to three before) by counters of tuples; what reaches before a text is space (0)."""
    levels = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = [0] * (order) + t
        for i in range(order, len(t)):
            levels[order][tuple(t[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts = [0.0]
    for k in range(1, order + 1):
        ones, twos = (sum(1 for n in levels[k].values() if n == x) for x in (1, 2))
        discounts.append(min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5)))

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (1 << language_id.BITS)
        same = {g: n for g, n in levels[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - discounts[k], 0) / total + discounts[k] * len(same) / total * p(gram[1:])

    return p


def test_kneser_ney_equals_plain_counters():
    rng = np.random.default_rng(0)
    texts = [rng.integers(2, 9, 40).tolist() for _ in range(12)]
    flat = np.concatenate([[0, *t] for t in texts]).astype(np.uint16)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    codes, counts = np.unique(language_id.text_grams(flat, starts)[0], return_counts=True)
    model = language_id.CharModel(codes, counts)
    p = plain_kneser_ney(texts)
    for gram in [*rng.integers(0, 12, (60, 4)).tolist(), texts[0][:4], texts[3][5:9], [0, 0, 0, 3], [0, 2, 3, 4]]:
        code = sum(x << (language_id.BITS * k) for k, x in enumerate(reversed(gram)))
        assert abs(model.losses(np.array([code], np.uint64))[0] + np.log(p(tuple(gram)))) < 1e-5
    for context in (int(codes[0]) >> language_id.BITS, 12345):
        every = (np.uint64(context) << np.uint64(language_id.BITS)) | np.arange(1 << language_id.BITS, dtype=np.uint64)
        assert abs(np.exp(-model.losses(every)).sum() - 1) < 1e-3


def test_remembered_losses_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefg "), 300)) for _ in range(20)] + [None, "", "x"]
    letters = [ord(c) for c in "abcdefg"]
    codes, counts = np.unique(language_id.text_grams(*language_id.symbols_of(texts[:10], language_id.symbol_table(letters)))[0], return_counts=True)
    models = [language_id.CharModel(codes, counts), language_id.CharModel(codes[::2], counts[::2])]
    whole = language_id.Scorer(letters, models).mean_losses(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 50)
    small = language_id.Scorer(letters, models)
    parts = [small.mean_losses([t]) for t in texts]
    assert np.allclose(whole[0], np.concatenate([p[0] for p in parts])) and (whole[1] == np.concatenate([p[1] for p in parts])).all()


def test_scripts_keep_their_letters(spark):
    rng = np.random.default_rng(3)
    scripts = {"ru": "абвгдежзийклмнопрстуфхцчшщ", "el": "αβγδεζηθικλμνξοπρστυφχψω", "en": "abcdefghijklmnopqrstuvwxyz", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщ"}
    rows = []
    for i in range(160):
        lang = list(scripts)[i % 4]
        letters = list(scripts[lang])
        share = np.arange(1, len(letters) + 1) ** (1.5 if lang == "uk" else -1.0)
        rows.append((i, " ".join("".join(rng.choice(letters, 6, p=share / share.sum())) for _ in range(40)), lang, "s", 1))
    table = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(table, learn=F.col("doc_id") < 120)
    assert {ord(c) for text in scripts.values() for c in text[:5]} <= set(model.letters)
    got = language_id.identify(table.where("doc_id >= 120"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) == 40


# toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}" for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.integers(30)] = ["vilething", "vilestuff"][rng.integers(2)]
        rows.append((i, " ".join(words), "en", "s", 1))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "plain " * 5000 + "vilethings", "en", "s", 1)]
    table = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), labels[0]], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(table, toxicity.label_categories(known), toxicity.CATEGORIES)
    got = {r.doc_id: r for r in toxicity.classify(table.withColumn("toxic", F.lit(3)), chain).collect()}
    fresh = [got[i].toxic == (i % 5 == 0) for i in range(300, 400)]
    assert sum(fresh) >= 97
    assert not got[900].toxic and not got[901].toxic and got[902].toxic
    blank = toxicity.fit(table, toxicity.label_categories(known.limit(0)), toxicity.CATEGORIES)
    assert toxicity.classify(table, blank).where("toxic").count() == 0
    assert toxicity.classify(table.limit(0), chain).count() == 0


def brute_features(text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return words | {"-" + w[:n] for w in words for n in toxicity.PREFIXES if len(w) >= n}


def test_toxicity_equals_a_plain_chain(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{chr(97 + rng.integers(26))}" + "tail" * int(rng.integers(0, 3)) for _ in range(12)) + (" Vile1thing" if i % 4 == 0 else "") for i in range(120)]
    texts += [None, "", "123 _ !", "ÀÉ vile_thing x²"]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(120)], "doc_id long, low int, toxic int")
    chain = toxicity.fit(table, labels, ["low", "toxic"])
    counts = Counter(f for t in texts[:120] for f in brute_features(t))
    kept = {f for f, n in counts.items() if 4 <= n <= max(6, int(0.3 * 120))}
    assert len(chain.vocabulary) == len(kept)
    number = {f: int(h) for f in kept for h in [toxicity.features_of([f.lstrip("-")])[1][0]] if not f.startswith("-")}
    place = {f: int(np.searchsorted(chain.vocabulary, np.uint64(h))) for f, h in number.items()}
    prefixes = {}
    for f in kept:
        if f.startswith("-"):
            row, found = toxicity.features_of([f[1:]])
            prefixes[f] = int(np.searchsorted(chain.vocabulary, found[1 + [n for n in toxicity.PREFIXES].index(len(f) - 1)]))
    place |= prefixes
    assert len(set(place.values())) == len(kept)
    p, decided = chain.predict(texts)
    for i, t in enumerate(texts):
        at, earlier = [place[f] for f in brute_features(t) & kept], []
        for k, w in enumerate(chain.weights):
            logit = w[at].sum() + w[-1] + sum(e * x for e, x in zip(earlier, w[len(kept) : -1]))
            assert abs(p[i, k] - 1 / (1 + np.exp(-logit))) < 1e-9
            earlier.append(np.clip(logit, -6, 6))
        assert decided[i] == (bool(brute_features(t)) and p[i, -1] >= chain.threshold)


# language-model scores


def test_lm_score(spark):
    rng = np.random.default_rng(4)
    good = [" ".join(rng.choice(["red", "blue", "sky", "sea"], 30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["foo", "bar", "baz", "red"], 30)) for _ in range(60)]
    table = docs(spark, [*good, *bad, None, "", "!!!"])
    target = spark.createDataFrame([(i,) for i in [*range(40), 3]] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_corpus(table.withColumn("score", F.lit(1)), target).collect()}
    assert max(got[i].score for i in range(60)) < min(got[i].score for i in range(60, 120))
    assert all(got[i].n_tokens == 0 and got[i].score is None for i in (120, 121, 122))
    assert got[7].text == good[7] and got[7].lang == "en"
    flat = lm_score.score_corpus(table, target.limit(0)).where("score is not null").collect()
    assert len(flat) == 120 and all(abs(r.score) < 1e-6 for r in flat)
    assert lm_score.score_corpus(table.limit(0), target).count() == 0
    assert lm_score.score(table.limit(0), lm_score.fit(table.limit(0), target)).count() == 0


def exact_losses(texts, is_target, new=None):
    """Both models' mean losses of each text, from plain counters; a counted text's own counts are taken out."""
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    uni, ctx, bi = ([Counter(), Counter()] for _ in range(3))
    for w, good in zip(words, is_target, strict=True):
        for k in (0, 1) if good else (1,):
            uni[k].update(w)
            ctx[k].update([None, *w][: len(w)])
            bi[k].update(zip([None, *w], w))
    size, size_all, vocabulary = sum(uni[0].values()), sum(uni[1].values()), len(uni[1]) + 1
    out = []
    for w, good in zip(words, is_target, strict=True) if new is None else [(re.findall(r"[^\W_]+", t.lower()), False) for t in new]:
        own, own_ctx, own_bi, losses = Counter(w), Counter([None, *w][: len(w)]), Counter(zip([None, *w], w)), []
        for k, scale in ((0, 1.0), (1, size / size_all)):
            mine = scale if new is None and (k or good) else 0
            total = 0.0
            for before, x in zip([None, *w], w):
                low = (uni[k][x] * scale - mine * own[x] + 0.5) / (size - mine * len(w) + 0.5 * vocabulary)
                context = ctx[k][before] * scale - mine * own_ctx[before]
                high = (bi[k][before, x] * scale - mine * own_bi[before, x]) / max(context, 1e-9)
                weight = 0.6 * context / (context + 5)
                total -= np.log(weight * high + (1 - weight) * low)
            losses.append(total / len(w) if w else None)
        out.append((len(w), *losses))
    return out


@pytest.mark.parametrize("batch, part", [(lm_score.BATCH_TOKENS, lm_score.TOKENS_PER_PART), (2500, 9000)])
def test_lm_score_equals_plain_counters(spark, monkeypatch, batch, part):
    monkeypatch.setattr(lm_score, "BATCH_TOKENS", batch)
    monkeypatch.setattr(lm_score, "RUN_CHARS", 3 * batch)
    monkeypatch.setattr(lm_score, "TOKENS_PER_PART", part)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60_000, 2000)) for _ in range(30)] + [" ".join(f"w{i}" for i in rng.integers(0, 40, 300)) for _ in range(20)]
    texts += [texts[3], texts[3], "w1 w2 W1 w2 unheard", "w1", None, "", "Ünder_score 12x"]
    is_target = [i % 3 == 0 for i in range(len(texts))]
    table = docs(spark, texts).repartition(3)
    target = spark.createDataFrame([(i,) for i, good in enumerate(is_target) if good], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_corpus(table, target, keep_text=False).collect()}
    for i, (n, t, b) in enumerate(exact_losses(texts, is_target)):
        assert got[i].n_tokens == n
        if n:
            assert abs(got[i].target_loss - t) < 1e-9 and abs(got[i].background_loss - b) < 1e-9 and abs(got[i].score - (t - b)) < 1e-9
    new = ["w1 neverseen w2", "neverseen", texts[0]]
    found = lm_score.score(docs(spark, new), lm_score.fit(table, target)).orderBy("doc_id").collect()
    for r, (n, t, b) in zip(found, exact_losses(texts, is_target, new), strict=True):
        assert r.n_tokens == n and abs(r.target_loss - t) < 1e-9 and abs(r.background_loss - b) < 1e-9


def test_lm_models_sum_to_one(spark):
    texts = ["a b a c", "b a", "c c c b"]
    table = docs(spark, texts)
    models = lm_score.fit(table, spark.createDataFrame([(0,), (2,)], "doc_id long"))
    after = docs(spark, [f"a {w}" for w in ("a", "b", "c", "unheard")])
    rows = lm_score.score(after, models).collect()
    first = exact_losses(texts, [True, False, True], ["a"])[0]
    for name, k in (("target_loss", 1), ("background_loss", 2)):
        assert abs(sum(np.exp(-(2 * r[name] - first[k])) for r in rows) - 1) < 1e-9


# main text


def test_main_text():
    page = '<html><head><title>T</title></head><body><nav>menu</nav><div class="ad">buy</div><article><header><h1>A &amp; B&nbsp;C</h1></header><p>one <b>two</b>\n three<p>four &lt;p&gt;<ul><li>x<li>y</ul><form>f</form><section id="comments"><p>no</section><script>"</article>"</script>end</article><aside>s</aside><footer>f'
    assert html_text.main_text(page) == "A & B C\none two three\nfour <p>\nx\ny\nend"
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("a < b & c") == "a < b & c"
    assert html_text.main_text("<p>x" + "<div>" * 3000 + "deep") == "x\ndeep"
    assert html_text.main_text("<p>cut <!-- never closed <p>gone") == "cut" and html_text.main_text("<p>cut <a href='x") == "cut"
    assert html.unescape("&am") == "&am"


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'data-hidden="false"', 'title="A hidden gem"', 'data-id="nav"', 'data-class="sidebar"', 'class="content no-sidebar"', 'id="page-with-nav"', 'class="has-banner"', 'class="widget"', 'id=nav'])
def test_no_article_is_lost(attrs):
    assert html_text.main_text(f"<body><div {attrs}><article><p>whole story</p></article></div></body>") == "whole story"
    if attrs not in ('class="widget"', "id=nav"):
        assert html_text.main_text(f"<body><p>first</p><div {attrs}><p>second</p></div></body>") == "first\nsecond"


@pytest.mark.parametrize("attrs", ['id="related-work"', 'class="post no-comments"', 'class="content has-sidebar"', 'class="share-price"', 'class="notice-period-law"'])
def test_parts_of_names_drop_nothing(attrs):
    assert html_text.main_text(f"<body><p>first</p><section {attrs}><p>second</p></section><footer>f</footer></body>") == "first\nsecond"


def test_a_teaser_is_not_the_article():
    page = "<body><div class=story><p>" + "the long story goes on " * 20 + "</p></div><div><article><h2>read this too</h2></article></div></body>"
    assert html_text.main_text(page).startswith("the long story") and html_text.main_text(page).endswith("read this too")


def test_deep_and_broken_pages_take_linear_time():
    for page in ("<div>" * 200_000 + "deep", "<b>" * 200_000 + "deep" + "</i>" * 200_000, "<a href=\"x>" * 100_000 + "deep", "<p>x<span>" * 50_000, "<div class=ad>" * 20_000 + "<article>" * 20_000 + "deep"):
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 12
    assert html_text.main_text("<div>" * 200_000 + "deep") == "deep"


def brute_importance(pages):
    """Importance of the paths of one host's pages, given as lists of (path, styles, texts) trees."""
    seen = defaultdict(lambda: (Counter(), Counter()))
    for page in {p: None for p in pages}:
        parsed = html_text.Page(page)
        texts = defaultdict(set)
        for node, text in parsed.blocks:
            while node.above is not None:
                texts[node.path].add(text)
                node = node.above
        for path, style in set(parsed.styles):
            seen[path][0][style] += 1
        for path, found in texts.items():
            seen[path][1].update(found)
    out = {}
    for path, (styles, texts) in seen.items():
        m = sum(styles.values())
        if m < html_text.MIN_PAGES:
            continue
        entropy = -sum(n / m * np.log(n / m) for n in styles.values()) / np.log(m)
        t = sum(texts.values())
        content = 1 - (sum(n * np.log(n) for n in texts.values()) / t / np.log(m) if t else 0)
        g = html_text.G ** len(styles)
        out[path] = (1 - g) * entropy + g * max(content, 0)
    return out


def test_importance_equals_plain_entropy(spark):
    rng = np.random.default_rng(5)
    html_of = lambda i: f"<body><div class=menu2><ul><li>home<li>news{rng.integers(2)}</ul></div><div class=s><p>own {i}</p>{'<h2>more</h2>' * int(rng.integers(3))}</div></body>"
    pages = [html_of(i) for i in range(30)]
    pages += pages[:3]
    table = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(4)
    got = {r.path: r.importance for r in html_text.path_importance(html_text.tree_evidence(table)).collect()}
    want = brute_importance(pages)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_named_branches_still_go():
    for attrs in ("hidden", "HIDDEN=''", "class='box ad'", "id=main-nav", 'class="site-footer"', "role=navigation"):
        assert html_text.main_text(f"<body><p>story</p><div {attrs}>menu</div></body>") == "story"
    assert html_text.main_text("<body><article>story</article><div class=comments><article>reply</article></div></body>") == "story"
    assert html_text.main_text("<body><nav><article>x</article></nav><p>story</p></body>") == "story"
    assert html_text.main_text("<body><div class=story>story</div><div class=related><article>other</article></div></body>") == "story\nother"
    assert html_text.main_text("<body><div id=widget><p>all there is</p></div></body>") == "all there is"


def test_site_tree_removes_what_recurs(spark):
    same = "<div class=box><p>Read our other offers every day</p></div>"
    rows = [(i, f"http://h/{i}", f"<body>{same}<div class=story><p>story {i} with its own words {i * 7}</p></div></body>") for i in range(12)]
    rows += [(50, None, None), (51, "http://h/x", ""), (52, "http://alone/x", f"<body>{same}</body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(pages.withColumn("text", F.lit(1)).withColumn("host", F.lit("own"))).collect()}
    assert got[3].host == "own"
    assert all(got[i].text == f"story {i} with its own words {i * 7}" for i in range(12))
    assert got[50].text == "" and got[51].n_chars == 0 and got[52].text == "Read our other offers every day"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_forms_around_the_page_and_inside_it():
    story = "<h1>Title</h1><p>the whole long story of the day</p>"
    for inner in (story, f"<article>{story}</article>", f"<div class=content>{story}</div>"):
        assert html_text.main_text(f"<body><form id='aspnetForm'><nav>menu</nav>{inner}<input value=x></form><footer>f</footer></body>") == "Title\nthe whole long story of the day"
    assert html_text.main_text(f"<body>{story}<form><p>sign up here</p></form></body>") == "Title\nthe whole long story of the day"
    assert html_text.main_text(f"<body><article>{story}<form><p>leave a reply</p></form></article></body>") == "Title\nthe whole long story of the day"
    assert html_text.main_text("<body><form>Search</form></body>") == ""
    assert html_text.main_text(f"<body>{story}<div role=form>x</div></body>").startswith("Title\nthe whole")


@pytest.mark.parametrize("name", ["header", "site-header", "page-header", "reader-comments", "user-comments", "comment-thread", "share-buttons", "related-posts", "newsletter-signup", "google-ad", "cookie-message", "breadcrumb-trail", "mainNav", "sidebarLeft", "topbar"])
def test_names_of_what_is_not_the_article(name):
    for attr in ("class", "id"):
        assert html_text.main_text(f"<body><div {attr}='{name}'>noise</div><p>story</p></body>") == "story"
        if "eader-" not in name and "header" not in name or name.endswith("comments"):
            assert html_text.main_text(f"<body><article><p>story</p><div {attr}='{name}'>noise</div></article></body>") == "story"


@pytest.mark.parametrize("name", ["related-work", "post-header", "article-header", "has-menu", "posts", "story", "no-sidebar"])
def test_names_that_stay(name):
    assert html_text.main_text(f"<body><div class='{name}'>kept</div><p>story</p></body>") == "kept\nstory"
    assert html_text.main_text("<body><article><div class=header>kept</div><p>story</p></article></body>") == "kept\nstory"


@pytest.mark.parametrize("page", ["<div><article>" + "<b>" * 100_000 + "</div>x" * 100_000, "<div class=menu>" + "<div>" * 50_000 + "<article>a</article>" * 50_000, "<table><tr><td>" * 30_000 + "</p>" * 100_000, "<form>" * 50_000 + "<p>x" * 50_000])
def test_a_megabyte_of_nesting_takes_seconds(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 8


@pytest.mark.parametrize("scale", ["1e-60", "1e60", "mixed", "1e-300"])
def test_nearest_of_extreme_norms(spark, monkeypatch, scale):
    monkeypatch.setattr(ann, "BLOCK", 1024)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 16)) * (10.0 ** rng.uniform(-60, -30, size=(6000, 1)) if scale == "mixed" else float(scale))
    ids = np.arange(-3000, 3000)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] * 1 + [(0, x[3000].tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 100 == 0, shortlist=64).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        score = x @ x[q + 3000]
        score[q + 3000] = -np.inf
        want = np.lexsort((ids, -score))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        hits, total = hits + len(set(ids[want]) & set(mine.vec_id)), total + 20
        assert list(mine["rank"]) == list(range(1, 21)) and len(set(mine.vec_id)) == 20
    if scale != "1e-300":  # products below the range of doubles are all 0: ties
        assert hits >= 0.9 * total


def test_patterns_of_one_opening_and_ending():
    """Windows of one bucket are looked up by hash, not listed."""
    items = [(f"i{k}", "alpha beta " + " ".join(f"w{k}x{j}" for j in range(9)) + " gamma delta") for k in range(5000)]
    tables = decontaminate.build_tables(items)
    words = decontaminate.words_of("alpha beta a b c d e f g h i gamma delta " * 5000 + items[77][1])
    start = time.time()
    assert [sorted(i) for t in tables for _, i in t.search(words)] == [["i77"]]
    assert time.time() - start < 0.5


def test_samples_keep_their_bounds_whatever_the_ids(spark):
    mark = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    words = [(f"the common words of number {mark(i)} and " if i % 2 else f"les mots communs du nombre {mark(i)} et ") * 12 for i in range(400)]
    for ids in ([None] * 400, [7] * 400, list(range(400))):
        rows = [(i, t, "en" if k % 2 else "fr") for k, (i, t) in enumerate(zip(ids, words, strict=True))] + [(None, words[0], "fr")] * 300
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = language_id.labelled_rows(table, "text", "lang", F.lit(True), 40).groupBy("lang", "trains").count().collect()
        assert len(got) == 4 and all(20 <= r["count"] <= 62 for r in got)
        model = language_id.fit(table, learn=F.lit(True), max_texts=40)
        assert np.isfinite(model.limits).all()
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(50)], "doc_id long, low_quality int, toxic int")
    docs = spark.createDataFrame([(i % 3, f"text {i % 100}") for i in range(900)] + [(1, "again")] * 200, "doc_id long, text string")
    sample = toxicity._sample(docs, labels, ["low_quality", "toxic"], "doc_id", "text", 60)
    assert sample.count() == 60 == sample.distinct().count()
    pages = spark.createDataFrame([(1, "http://a/", f"page {i} " * 30) for i in range(50)] + [(1, "http://a/", "hot " * 2000)] * 100, "page_id long, url string, html string")
    assert isinstance(warc.train_dictionary(pages, "page_id", "url", "html"), bytes)
