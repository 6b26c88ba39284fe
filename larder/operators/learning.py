"""Evaluation and training of the swap ranker."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.sources.scratch import cut


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their mean by their population deviation (1 where that is 0)."""
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in columns))
    joined = rows.join(F.broadcast(stats))  # one row
    return joined.select(*(c for c in rows.columns if c not in columns), *(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in columns))


def precision_recall(rows: DataFrame, expected: str, actual: str, confident: Column) -> DataFrame:
    """One row: precision and recall of matches, confident errors, correct refusals; 1 where undefined."""
    got, want = F.col(actual).isNotNull(), F.col(expected).isNotNull()
    right = got & want & (F.col(actual) == F.col(expected))
    n = lambda c, name: F.count_if(c).alias(name)
    sums = rows.agg(n(got, "answered"), n(want, "answerable"), n(right, "correct"), n(got & ~F.coalesce(right, F.lit(False)) & confident, "confident_wrong"), n(~got & ~want, "withheld"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(1.0))
    return sums.withColumns({"precision": ratio("correct", "answered"), "recall": ratio("correct", "answerable")})


def accuracy_by(rows: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """Accuracy of each key value and of all rows (key ``all``) in one pass of grouping sets."""
    right = F.coalesce(F.col(expected).eqNullSafe(F.col(actual)), F.lit(False))
    grouped = rows.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_correct"), F.grouping(key).alias("g"))
    return grouped.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce(F.col(key), F.lit("none"))).alias(key), "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("accuracy"))


def stratified_folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, buckets: int = 256) -> DataFrame:
    """Rows with a fold number; each label is dealt evenly in a seeded order.

    Rows are numbered inside (label, bucket of the order) and the buckets before
    are added, so a label with most rows is spread over the tasks.
    """
    mixed = F.xxhash64(F.col(key), F.lit(seed))
    placed = rows.withColumn("_bucket", F.shiftrightunsigned(mixed, 56).cast("int") % buckets)
    sizes = placed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy(mixed, key)) - 1
    numbered = placed.withColumn("_inside", inside).join(offsets, [label, "_bucket"])
    return numbered.withColumn("fold", (F.col("_inside") + F.col("_skip")) % k).drop("_bucket", "_inside", "_skip")


@dataclass(frozen=True)
class Fit:
    """A logistic model over standardised features."""

    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    intercept: float


def _sums(rows: DataFrame, step, ddl_keys: str) -> dict[tuple, np.ndarray]:
    """Vectors by key, summed over all tasks by Spark: ``step`` gives (keys, vector) pairs of each task's batches."""
    names = [x.split(" ")[0] for x in ddl_keys.split(", ")]

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, vector in step(batch):
                held[key] = held.get(key, 0) + vector
        for key, vector in held.items():
            columns = [pa.array([k] * len(vector)) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(vector))), pa.array(np.asarray(vector, float))], names=[*names, "at", "value"])

    summed = rows.mapInArrow(run, f"{ddl_keys}, at long, value double").groupBy(*names, "at").agg(F.sum("value").alias("value")).collect()
    out: dict[tuple, np.ndarray] = {}
    for r in sorted(summed, key=lambda r: r["at"]):
        out.setdefault(tuple(r[n] for n in names), []).append(r["value"])
    return {k: np.array(v) for k, v in out.items()}


def fit_folds(rows: DataFrame, features: list[str], label: str, fold: str | None, k: int, penalty: float = 0.01, steps: int = 12) -> dict[int, Fit]:
    """Models by the fold that they leave out, and by -1 one of all rows; a null feature counts as its mean.

    All of them are fitted together by Newton's method: a step is one pass over the rows, which gives every
    model's gradient and curvature, summed in each task and then by Spark.  What reaches the driver is
    bounded by the number of folds and features.  Loss: mean logistic loss plus half the penalty times the
    squared weights of the standardised features (population deviation, 1 where that is 0).
    """
    d = len(features)
    table = rows.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)), F.col(label).cast("double").alias("y"), (F.col(fold).cast("long") if fold else F.lit(-2).cast("long")).alias("fold"))
    table = cut(table.where("y is not null"))

    def values(batch):
        x = np.column_stack([batch.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(d)])
        return x, batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)

    def moments(batch):
        x, y, of = values(batch)
        for f in np.unique(of):
            part = x[of == f]
            known = ~np.isnan(part)
            yield (int(f),), np.concatenate([known.sum(axis=0), np.nansum(part, axis=0), np.nansum(part**2, axis=0), [len(part)]])

    by_fold = {key[0]: v for key, v in _sums(table, moments, "fold long").items()}
    if not by_fold:
        return {}
    whole = sum(by_fold.values())
    left_out = [-1, *(range(k) if fold else ())]
    scale, size = {}, {}
    for m in left_out:
        part = whole - by_fold.get(m, 0)
        n = np.maximum(part[:d], 1)
        mean = part[d : 2 * d] / n
        deviation = np.sqrt(np.maximum(part[2 * d : 3 * d] / n - mean**2, 0))
        scale[m], size[m] = (mean, np.where(deviation > 1e-12, deviation, 1.0)), max(part[-1], 1)
    theta = {m: np.zeros(d + 1) for m in left_out}
    for _ in range(steps):
        now = {m: t.copy() for m, t in theta.items()}

        def slopes(batch, now=now):
            x, y, of = values(batch)
            for m, t in now.items():
                use = of != m
                z = np.nan_to_num((x[use] - scale[m][0]) / scale[m][1])
                z = np.column_stack([z, np.ones(len(z))])
                p = 1 / (1 + np.exp(-np.clip(z @ t, -40, 40)))
                yield (m,), np.concatenate([z.T @ (p - y[use]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        moved, ridge = 0.0, np.diag([penalty] * d + [0.0])
        for (m,), v in _sums(table, slopes, "model long").items():
            gradient = v[: d + 1] / size[m] + ridge @ theta[m]
            curve = v[d + 1 :].reshape(d + 1, d + 1) / size[m] + ridge + 1e-9 * np.eye(d + 1)
            change = np.linalg.solve(curve, gradient)
            theta[m] -= change
            moved = max(moved, float(np.abs(change).max()))
        if moved < 1e-10:
            break
    return {m: Fit(*scale[m], t[:d], float(t[d])) for m, t in theta.items()}


def cross_validate(rows: DataFrame, features: list[str], key: str, label: str = "is_good", k: int = 5, penalty: float = 0.01) -> DataFrame:
    """One row a fold: size, accuracy of the model that has not seen it, and the share of the larger class."""
    folded = cut(stratified_folds(rows, label, key, k))
    models = fit_folds(folded, features, label, "fold", k, penalty)
    right = F.lit(None).cast("boolean")
    for m, fit in models.items():
        if m >= 0:
            filled = probability(fit, features)
            right = F.when(F.col("fold") == m, (filled > 0.5) == (F.col(label) == 1)).otherwise(right)
    share = F.avg(F.col(label).cast("double"))
    return folded.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))


def probability(fit: Fit, features: list[str]) -> Column:
    """The model's probability, null features at their mean."""
    z = F.lit(float(fit.intercept))
    for name, mean, scale, weight in zip(features, fit.means, fit.scales, fit.weights, strict=True):
        z = z + F.coalesce((F.col(name).cast("double") - float(mean)) / float(scale), F.lit(0.0)) * float(weight)
    return 1 / (1 + F.exp(-z))
