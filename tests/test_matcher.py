"""The fuzzy matcher and the tiers against a sequential matcher over plain dictionaries, on the whole smallest tables."""

import os
import re
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from larder.functions import text as X, words as W
from larder.operators import matching
from larder.plans import screen_queries as Q, testdata as D

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def stem(w):
    return re.sub("(en|e|n|s)$", "", w) if len(w) > 4 else w


@lru_cache(None)
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def spelled(a, b):
    return 1 - edits(a, b) / max(len(a), len(b))


@lru_cache(None)
def similarity(o, n):
    least, ratio = min(len(o), len(n)), min(len(o), len(n)) / max(len(o), len(n))
    if o == n:
        return 1.0
    if least < 4:
        return 0.0
    if n.startswith(o) or o.startswith(n):
        return 0.97 if stem(o) == stem(n) else 0.5 + ratio * 0.35
    sim = spelled(o, n)
    if 0.45 < sim <= 0.75 and (stem(o) != o or stem(n) != n):
        sim = max(sim, spelled(stem(o), stem(n)))
    if sim > 0.7:
        return sim
    if least >= 5 and (o in n or n in o):
        return 0.4 + ratio * 0.35
    return 0.6 if any(n.startswith(e) or n.endswith(e) for e in (o[:4], o[-4:])) else 0.0


def pieces(w, n):
    return {w[i : i + n] for i in range(len(w) - n + 1)}


class Index:
    def __init__(self, pairs):
        self.ids, self.stems, self.five, self.four = (defaultdict(set) for _ in range(4))
        for i, token in pairs:
            self.ids[token].add(i)
            self.stems[stem(token)].add(i)
        for token in self.ids:
            for g in pieces(token, 5) if len(token) >= 5 else {token}:
                self.five[g].add(token)
            for g in pieces(token, 4) if 4 <= len(token) <= 10 else ():
                self.four[g].add(token)

    def hits(self, tokens):
        hits, first, recognized, alone = defaultdict(int), {}, defaultdict(bool), []

        def add(i, pos, n):
            hits[i] += n
            first.setdefault(i, pos)

        for pos, q in enumerate(tokens):
            strong = set()
            if q in self.ids:
                strong |= {(0, i) for i in self.ids[q]}
            if stem(q) != q:
                strong |= {(1, i) for i in self.stems.get(stem(q) if stem(q) in self.stems else q, ())}
            for _, i in strong:
                add(i, pos, 2)
                recognized[i] |= q not in W.DESCRIPTORS
            near = set()
            if len(q) >= 4:
                close = lambda t: abs(len(t) - len(q)) <= 2  # noqa: E731, B023
                near = {t for g in (pieces(q, 5) if len(q) >= 5 else {q}) for t in self.five.get(g, ()) if q in t or t in q or close(t)}
                if not near and 5 <= len(q) <= 8:
                    near = {t for g in pieces(q, 4) for t in self.four.get(g, ()) if close(t)}
            for t in near:
                for i in self.ids[t]:
                    add(i, pos, 1)
            if 5 <= len(q) <= 10 and q not in self.ids:
                alone.append((pos, q))
        for pos, q in [x for x in alone if x[0] not in set(first.values())]:
            n = len(q)
            levels = [{q[:i] + a + q[i + 1 :] for i in range(n) for a in W.CONFUSIONS.get(q[i], "")}, {q[:i] + q[i + 1 :] for i in range(n)}]
            levels.append({q[:i] + a + q[i:] for i in range(n + 1) for a in "abcdefghijklmnopqrstuvwxyz"} if n <= 9 else set())
            for made in levels:
                found = [(v, k, i) for v in made for k, ids in ((0, self.ids.get(v, ())), (1, self.stems.get(stem(v), ()))) for i in ids]
                for _, _, i in found:
                    hits[i] += 2
                    first[i] = min(first.get(i, pos), pos)
                if found:
                    break
        return hits, first, recognized


def form(tokens):
    return any(t == "dough" or (t.endswith("teig") and "waren" not in t) or (len(t) >= 6 and t.endswith("eis") and not t.endswith("reis")) for t in tokens)


def any_word(tokens, parts):
    return any(re.search("|".join(parts), t) for t in tokens)


def confidence(o, n, full, heads, parens, fat, food_fat, english, english_name, core_nouns):
    best = [max((similarity(t, x) for x in n), default=0.0) for t in o]
    at = next((i for i, t in enumerate(o) if t in core_nouns or t in heads), None)
    weights = [0.0 if t in W.DESCRIPTORS else (5.0 if t in heads else 3.0) * (1.5 if i == 0 else 1.0) if i == at else 1.0 for i, t in enumerate(o)]
    conf = sum(b * w for b, w in zip(best, weights)) / sum(weights) if sum(weights) else 0.0
    if at is not None and best[at] > 0.8 and n and similarity(o[at], n[0]) >= best[at]:
        conf += 0.08
    counted = [t for t in n if t not in W.IMPLICIT_QUALIFIERS and t not in parens]
    covered = [(3.0 if t in core_nouns else 1.0, any(q == t or spelled(q, t) > 0.6 or (len(t) >= 4 and (q in t or t in q)) for q in o)) for t in counted]
    share = sum(w for w, hit in covered if hit) / sum(w for w, _ in covered) if covered else 1.0
    conf = conf * 0.65 + share * 0.35
    whole = spelled(" ".join(o), full)
    if whole > conf and whole > 0.6 and conf > 0.1:
        conf = whole
    conf *= 0.85 if english else 1
    conf *= 0.6 if any_word(n, W.PLANT_WORDS) and not any_word(o, W.PLANT_WORDS) else 1
    conf *= 0.7 if any_word(n, W.DIET_WORDS) and not any_word(o, W.DIET_WORDS) else 1
    conf *= 0.65 if form(n) and not form(o) else 1
    conf *= 0.8 if any_word(n, W.COMPOSITE_WORDS) else 1
    if conf < 0.95 and re.search(r"(?i)(?<![A-Za-z0-9_])E[-\s]?\d{3}(?![A-Za-z0-9_])|additive|chemical|curing salt", english_name):
        conf *= 0.4
    bonus = max((0.55 if q == t else 0.5 if spelled(stem(q), stem(t)) > 0.75 else 0.0 for q in o for t in n if q in core_nouns or t in core_nouns), default=0.0)
    conf = min(0.95, conf + bonus * 0.2)
    if fat is not None:
        conf -= abs(fat - food_fat) * 0.01 if food_fat is not None else 0.05
    return conf, sum(not hit for _, hit in covered)


def test_fuzzy_match_equals_a_sequential_matcher(spark):
    foods, lines = D.frame(spark, SF, D.CATALOG), D.frame(spark, SF, D.NOISY_LINES)
    index = Index([(r.id, r.token) for r in matching.food_tokens(foods).collect()])
    columns = [F.col("id"), F.col("row_ord"), F.col("name")]
    for key, name in (("de", "name_de"), ("en", "name")):
        columns += [X.normalize(F.col(name)).alias(f"{key}_raw"), X.ascii_fold(F.col(name)).alias(f"{key}_ascii"), X.fat_percent(F.col(name)).alias(f"{key}_fat")]
    columns.append(F.concat(X.paren_tokens(F.col("name")), F.coalesce(X.paren_tokens(F.col("name_de")), F.expr("cast(array() as array<string>)"))).alias("parens"))
    catalog = {r.id: r for r in foods.select(*columns).collect()}
    prepared = matching.prepare_lines(lines).collect()
    words = {t for r in catalog.values() for k in ("de_raw", "de_ascii", "en_raw", "en_ascii") for t in (r[k] or "").split()} | {t for r in prepared for t in [*r.raw, *r.ascii]}
    core = {r.w for r in spark.createDataFrame([(w,) for w in words], "w string").where(X.is_core_noun(F.col("w"))).collect()}
    want = {}
    for line in prepared:
        hits, first, recognized = index.hits(list(dict.fromkeys([*line.raw, *line.ascii])))
        if not any(recognized.values()):
            continue
        ranked = sorted(hits, key=lambda i: (-hits[i], first[i], catalog[i].row_ord))[: matching.MAX_CANDIDATES]
        tried = []
        for i in ranked:
            food = catalog[i]
            for key in ("de", "en"):
                for kind in ("raw", "ascii"):
                    full, o = food[f"{key}_{kind}"], line[kind]
                    if full is None or not o or (kind == "ascii" and line.raw == line.ascii and food[f"{key}_raw"] == full):
                        continue
                    n = [t for t in full.split() if len(t) > 2]
                    conf, unmatched = confidence(o, n, full, set(line.heads), set(food.parens), line.fat, food[f"{key}_fat"], key == "en", food.name, core)
                    tried.append((conf, unmatched, hits[i], food.row_ord, i))
        if tried:
            top = max(t[0] for t in tried)
            near = [t for t in tried if t[0] >= top - matching.BAND - 1e-12]
            best = min(near, key=lambda t: (t[1], -t[0], -t[2], t[3]))
            want[line.line_id] = (best[4], best[0])
    got = {r.line_id: (r.food_id, r.confidence) for r in matching.fuzzy_match(lines, foods).collect()}
    assert len(want) > 150 and got.keys() == want.keys()
    wrong = [(k, got[k], want[k]) for k in want if abs(got[k][1] - want[k][1]) > 1e-9 or got[k][0] != want[k][0]]
    assert not wrong, wrong[:3]


def embedded(line, key):
    """2 for a whole word, 1 inside one, 0 if all occurrences are processed forms or there is none."""
    letter, found = "[a-zäöüß]", 0
    for m in re.finditer(f"(?={re.escape(key)})", line):
        end = m.start() + len(key)
        rest = re.match(f"{letter}*", line[end:])[0]
        if any(rest.endswith(s) for s in W.PROCESSED_SUFFIXES):
            continue
        whole = not re.match(letter, line[m.start() - 1 : m.start()]) and not rest
        found = max(found, 2 if whole else 1)
    return found


def test_tiers_equal_a_sequential_resolution(spark):
    foods, lines = D.frame(spark, SF, D.CATALOG), D.frame(spark, SF, D.NOISY_LINES)
    catalog = sorted(foods.select("row_ord", "id", "name", "name_de").collect())
    names = {}
    for r in catalog:
        for name in (r.name_de, r.name):
            if name is not None:
                names.setdefault(name, r.id)
    rows = lines.select("line_id", "raw_text", X.override_key(F.col("raw_text")).alias("okey"), X.is_product_line(F.col("raw_text")).alias("product")).collect()
    fuzzy = {r.line_id: (r.food_id, r.confidence) for r in matching.fuzzy_match(lines.where(X.is_product_line(F.col("raw_text"))), foods).collect()}
    overrides = {}
    for r in rows:
        if int(r.line_id) % 7 == 0:
            overrides.setdefault(r.okey, set()).add(r.line_id)
    assert all(len(x) == 1 for x in overrides.values())
    exact = {r.name.lower(): r.name for r in catalog if r.row_ord % 6 == 0}
    brands = {r.name_de.lower(): r.name_de for r in catalog if r.row_ord % 5 == 4 and r.name_de is not None}
    barred = {r.name.lower() for r in catalog if r.row_ord % 12 == 0}
    want = {}
    for r in rows:
        low = r.raw_text.strip().lower()
        brand = max(((embedded(low, k), len(k), [-ord(c) for c in k], k) for k in brands if embedded(low, k)), default=None)
        brand = brands[brand[3]] if brand else None
        if r.okey in overrides:
            want[r.line_id] = (next(iter(overrides[r.okey])), 1.0, "override")
            continue
        best = fuzzy.get(r.line_id, (None, 0.0)) if r.product else None
        if low in exact:
            found = (names[exact[low]], 0.99, "exact")
        elif brand and not (brand.endswith(" roh") and best and best[1] >= 0.72):
            found = (names[brand], 0.95, "brand")
        elif best is not None:
            found = (*best, "bls")
        else:
            continue
        want[r.line_id] = (None, 0.0, found[2]) if low in barred else found
    got = {r.line_id: (r.food_id, r.confidence, r.source) for r in Q.queries()["tier_resolve"](spark, SF).collect()}
    assert got.keys() == want.keys() and len({s for _, _, s in want.values()}) == 4
    wrong = [(k, got[k], want[k]) for k in want if got[k][0] != want[k][0] or got[k][2] != want[k][2] or abs(got[k][1] - want[k][1]) > 1e-4]
    assert not wrong, wrong[:3]
