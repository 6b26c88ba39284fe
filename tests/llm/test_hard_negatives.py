"""Hard negatives against all inner products, bounds against exact scores, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import hard_negatives as hn

ROWS = "vec_id long, label int, embedding array<double>"


def plain(rows, every, scale=256):
    """All pairs in Python's integers."""
    sound = [r for r in rows if None not in r and r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    if not sound:
        return []
    sizes = [len(r[2]) for r in sound]
    n = min(set(sizes), key=lambda s: (-sizes.count(s), s))
    most = hn.limit(n)
    ints = sorted((i, lab, [math.floor(max(-most, min(most, scale * x))) for x in v]) for i, lab, v in sound if len(v) == n)
    known = {}
    for i, lab, v in ints:
        known.setdefault(i, (lab, v))
    out = []
    for a, (lab, v) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in known.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == lab][:5]:
            window = [s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, i, k, j, -p, -s) for k, (s, j, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, every):
    table = spark.createDataFrame(rows, ROWS).withColumn("score", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("cells", F.lit(2))
    return sorted(map(tuple, hn.mine(table, F.col("vec_id") % every == 0, F.col("label")).collect()))


def clustered(rng, n, dimensions, spread=0.6):
    centres = rng.normal(size=(4, dimensions))
    return [(i, int(rng.integers(0, 5)), ((centres[rng.integers(4)] + spread * rng.normal(size=dimensions)) * 0.12).tolist()) for i in range(n)]


@pytest.mark.parametrize("dimensions", [1, 3, 16])
def test_equals_all_inner_products(spark, monkeypatch, dimensions):
    for name, value in (("ROW_BLOCK", 64), ("ANCHORS_AT_ONCE", 4), ("ANCHOR_BLOCK", 8)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(np.random.default_rng(dimensions), 400, dimensions)
    want = plain(rows, 10)
    assert mined(spark, rows, 10) == want and len(want) > 100


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROW_BLOCK", 64)
    rng = np.random.default_rng(9)
    rows = clustered(rng, 200, 4)
    common = rows[0][2]
    rows += [(1000 + i, i % 3, common) for i in range(150)]  # a vector that a third of the rows share
    rows += [(2000 + i, i % 2, rng.normal(size=4).round(1).tolist()) for i in range(60)]  # ties
    rows += [(3000, 1, [0.0] * 4), (3010, None, common), (3020, 1, None), (3030, 1, [None, 1.0, 1.0, 1.0]), (3040, 1, [math.nan] * 4), (3050, 1, [math.inf] * 4), (3060, 1, [1.0]), (3070, 1, []), (None, 1, common)]
    rows += rows[:30] + [(20, 4, common), (20, 0, [9.0, 9.0, 9.0, 9.0]), (40, 0, common)]  # repeated rows, ids with several rows
    want = plain(rows, 10)
    assert mined(spark, rows, 10) == want and len(want) > 100


def test_extreme_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(x) * 10.0 ** int(rng.integers(-30, 40)) for x in rng.normal(size=3)]) for i in range(80)]
    want = plain(rows, 4)
    assert mined(spark, rows, 4) == want and want


def test_no_rows(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, None, [1.0]), (10, 1, None)], 10) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])], 10) == []  # no positive


def test_bounds_hold_and_are_met(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-90, 90, size=(500, 7))
    points = np.quantile(x[:100], np.arange(1, hn.CELLS) / hn.CELLS, axis=0).T.astype(np.int64)
    cells = hn.cells_of(x, points)
    extents = np.zeros((2, 7, hn.CELLS), np.int64)
    for d in range(7):
        for c in np.unique(cells[:, d]):
            inside = x[cells[:, d] == c, d]
            extents[:, d, c] = inside.min(), inside.max()
    anchors = x[:9]
    lower, upper = hn.score_bounds(hn.packed_cells(cells), hn.bound_tables(anchors, extents))
    exact = x @ anchors.T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (upper - lower).mean() < 0.3 * (exact.max() - exact.min())
