"""The trainer of all folds against a plain fit of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import learning


def plain_fit(x, y, penalty):
    """Newton's method on one training set, null features at their mean."""
    mean = np.nanmean(x, axis=0)
    scale = np.sqrt(np.nanmean((x - mean) ** 2, axis=0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.column_stack([np.nan_to_num((x - mean) / scale), np.ones(len(x))])
    ridge, t = np.diag([penalty] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ t))
        t -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge, z.T @ (p - y) / len(z) + ridge @ t)
    return mean, scale, t


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4)) * [1, 30, 0.2, 1] + [0, 100, 5, 0]
    x[:, 3] = 7  # constant
    y = (x[:, 0] + x[:, 1] / 40 - 2.5 + rng.logistic(size=600) > 0).astype(int)
    x[rng.random(600) < 0.1, 1] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), int(y[i])) for i in range(600)]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, is_good int").repartition(5)


def test_all_folds_at_once(spark, data):
    x, y, rows = data
    folded = learning.cut(learning.stratified_folds(rows, "is_good", "id", 5))
    of = dict(folded.select("id", "fold").collect())
    fold = np.array([of[i] for i in range(600)])
    models = learning.fit_folds(folded, ["a", "b", "c", "d"], "is_good", "fold", 5)
    assert sorted(models) == [-1, 0, 1, 2, 3, 4]
    right = {}
    for m, fit in models.items():
        mean, scale, t = plain_fit(x[fold != m], y[fold != m], 0.01)
        assert np.allclose(fit.means, mean) and np.allclose(fit.scales, scale)
        assert np.abs(np.append(fit.weights, fit.intercept) - t).max() < 1e-6
        z = np.nan_to_num((x - mean) / scale) @ t[:-1] + t[-1]
        right[m] = float(((z > 0) == (y == 1))[fold == m].mean()) if m >= 0 else None
        got = dict(rows.select("id", learning.probability(fit, ["a", "b", "c", "d"])).collect())
        assert max(abs(got[i] - 1 / (1 + np.exp(-z[i]))) for i in range(600)) < 1e-9
    for r in learning.cross_validate(rows, ["a", "b", "c", "d"], "id").collect():
        assert abs(r.accuracy - right[r.fold]) < 1e-12 and r.n == (fold == r.fold).sum()
        assert abs(r.majority - max(y[fold == r.fold].mean(), 1 - y[fold == r.fold].mean())) < 1e-12
    assert np.mean([v for v in right.values() if v is not None]) > max(y.mean(), 1 - y.mean())


def test_one_class_and_no_rows(spark, data):
    _, _, rows = data
    assert learning.fit_folds(rows.limit(0), ["a"], "is_good", None, 5) == {}
    only = learning.fit_folds(rows.withColumn("is_good", F.lit(1)), ["a", "b"], "is_good", None, 5)[-1]
    assert np.isfinite(only.intercept) and only.intercept > 3 and np.abs(only.weights).max() < 1e-6
