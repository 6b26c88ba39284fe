"""Toxicity by a classifier chain of linear models over words and word beginnings.

Categories are predicted one after another.  Each category's logistic regression
sees the text's features and the log-odds of the categories before it.  For
training these come from out-of-fold predictions, so a later model learns from
earlier outputs as good as it will meet on new texts.  The decision threshold of
the last category is set on its own out-of-fold predictions.

Features are the distinct lower-case words of a text and their first 4, 5 and 6
letters, as present or absent, named by 64-bit hashes.  Kept are those in at least ``MIN_SHARE`` and at
most ``MAX_SHARE`` of the training texts; each model uses those of them that
differ between its classes (chi-square above ``LEAST_CHI`` on its own rows).

Training uses a hash sample of at most ``max_rows`` labelled rows (a documented
bound); features are counted by Spark, and the driver gets the kept features and
the sample's feature numbers only.  Scoring is one Arrow pass over whole texts.

Edge cases: null texts and texts without a word are never toxic, with the
probabilities of an empty text.  Label rows with a null in any category teach
nothing; repeated labels of one document count once, as the larger.  Repeated
document rows teach once and are judged alike; a probability
equal to the threshold is toxic.  A category
with one value only predicts its share.  Without labels nothing is toxic.
Extra columns are kept, those named as an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.llm.common import Scratch, bound_batches, mixed, run_hasher, runs_of, text_runs

MAX_ROWS = 8000
FOLDS = 3
MIN_SHARE, MAX_SHARE, MIN_TEXTS = 0.002, 0.3, 4
LEAST_CHI = 12.0
SLACK = 0.005
ROUNDS, RATE, PULL = 300, 0.15, 3e-5
PREFIXES = (4, 5, 6)
RUN_CHARS = 1_000_000
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters, for words."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)]))
    return _LETTER[0]


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of all words of ``texts`` and of their beginnings, with repeats."""
    units, starts, stops, n = runs_of(texts, letter_table())
    text = np.repeat(np.arange(len(texts)), n)
    hashes = run_hasher(units)
    rows, found = [text], [hashes(starts, stops)]
    for size in PREFIXES:
        long = stops - starts >= size
        rows.append(text[long])
        found.append(mixed(hashes(starts[long], starts[long] + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(found)


def numbered(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in the sorted ``vocabulary``) of the distinct known features of each text, in order; and which texts have words."""
    text, found = features_of(texts)
    worded = np.bincount(text, minlength=len(texts)) > 0
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64), worded
    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    known = vocabulary[at] == found
    return *np.divmod(np.unique(text[known] * len(vocabulary) + at[known]), len(vocabulary)), worded


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sparse:
    """Binary rows as (row, feature) pairs with a few dense columns."""

    def __init__(self, lists: list[np.ndarray], width: int, dense: np.ndarray):
        self.n, self.width, self.dense = len(lists), width, dense
        self.col = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])

    def logits(self, w: np.ndarray) -> np.ndarray:
        out = np.bincount(self.row, w[self.col], self.n) + w[-1]
        for k in range(self.dense.shape[1]):
            out += self.dense[:, k] * w[self.width + k]
        return out

    def only(self, keep: np.ndarray) -> Sparse:
        """The same rows without the features that ``keep`` leaves out; numbers stay."""
        out = Sparse([], self.width, self.dense)
        held = keep[self.col]
        out.n, out.col, out.row = self.n, self.col[held], self.row[held]
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width + self.dense.shape[1] + 1)
        out[: self.width] = np.bincount(self.col, g[self.row], self.width)
        for k in range(self.dense.shape[1]):
            out[self.width + k] = (self.dense[:, k] * g).sum()
        out[-1] = g.sum()
        return out


def telling(x: Sparse, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Which features differ between the classes by chi-square; dense columns and the intercept always stay."""
    n, pos = use.sum(), (y * use).sum()
    have, both = x.back(use.astype(float)), x.back(y * use)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (n * both - have * pos) ** 2 / (have * (n - have) * pos * (n - pos))
    keep = np.nan_to_num(chi, posinf=0.0) > LEAST_CHI
    keep[x.width :] = True
    return keep


def fit_logistic(x: Sparse, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights (features, dense columns, intercept) by full-batch Adam on the rows of ``use``."""
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    share = y[use].mean() if use.any() else 0.0
    w[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
    if not 0 < share < 1:
        return w
    weight = np.where(use, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)), 0) / use.sum()
    w[-1], keep = 0.0, telling(x, y, use)
    x = x.only(keep)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        g = x.back((_sigmoid(x.logits(w)) - y) * weight)
        g[:-1] += PULL * w[:-1]
        g *= keep
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest threshold whose F1 is within SLACK of the best on these predictions, at least one half."""
    if not 0 < y.sum() < len(y):
        return 1.1 if not y.any() else 0.5
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # equal predictions stay together
    near = np.nonzero(f1 >= f1.max() - SLACK)[0]
    k = int(near[-1])
    return max(0.5, float((p[order][k] + p[order][min(k + 1, len(y) - 1)]) / 2))


class Chain:
    """Fitted chain: vocabulary (sorted hashes), one weight vector a category, and the last one's threshold."""

    def __init__(self, categories: list[str], vocabulary: np.ndarray, lists: list[np.ndarray], labels: np.ndarray, folds: np.ndarray):
        self.categories, self.vocabulary = categories, vocabulary
        self.weights, earlier = [], np.zeros((len(lists), 0))
        p = np.zeros(len(lists))
        for k in range(len(categories)):
            x, y = Sparse(lists, len(vocabulary), earlier), labels[:, k]
            logits = np.zeros(len(lists))
            for fold in range(FOLDS):
                w = fit_logistic(x, y, folds != fold)
                logits = np.where(folds == fold, x.logits(w), logits)
            self.weights.append(fit_logistic(x, y, np.ones(len(y), bool)))
            p = _sigmoid(logits)
            earlier = np.column_stack([earlier, np.clip(logits, -6, 6)])
        self.threshold = best_threshold(p, labels[:, -1]) if len(lists) else 1.1

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, categories) probabilities in chain order, and the decision on the last."""
        row, at, worded = numbered(texts, self.vocabulary)
        x = Sparse([], len(self.vocabulary), np.zeros((len(texts), 0)))
        x.n, x.row, x.col = len(texts), row, at
        p = np.zeros((len(texts), len(self.weights)))
        for k, w in enumerate(self.weights):
            logits = x.logits(w)
            p[:, k] = _sigmoid(logits)
            x.dense = np.column_stack([x.dense, np.clip(logits, -6, 6)])
        return p, worded & (p[:, -1] >= self.threshold)


def _sample(documents: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(id, text, categories): at most ``max_rows`` labelled documents drawn by hash, repeated rows once."""
    known = labels.where(F.col(id_col).isNotNull()).dropna(subset=categories).groupBy(id_col).agg(*(F.max(c).alias(c) for c in categories))
    drawn = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    # both broadcasts are bounded by max_rows; an id may have many rows, so rows are drawn too, without their texts
    pairs = rows.select("id", "text_hash").join(F.broadcast(drawn.withColumnRenamed(id_col, "id")), "id").distinct()
    pairs = pairs.orderBy(F.xxhash64("id", "text_hash"), "id").limit(max_rows)
    return rows.join(F.broadcast(pairs), ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]).select("id", "text", *categories)


def _vocabulary(sample: DataFrame, n: int) -> np.ndarray:
    def count(batches):
        for batch in batches:
            for _, _, texts in text_runs(batch.column("text"), RUN_CHARS):
                text, found = features_of(texts)
                value, place = np.unique(found, return_inverse=True)
                of_text = np.unique(text * max(len(value), 1) + place) % max(len(value), 1)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.bincount(of_text, minlength=len(value)))], names=["feature", "n"])

    counted = sample.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n").between(max(MIN_TEXTS, int(MIN_SHARE * n)), max(MIN_TEXTS + 2, int(MAX_SHARE * n))))
    return np.sort(kept.select("feature").toArrow().column("feature").to_numpy().view(np.uint64))


def fit(documents: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Chain:
    """A chain over ``categories`` (0/1 columns of ``labels``, in chain order)."""
    bound_batches(documents.sparkSession)
    with Scratch(documents.sparkSession) as work:
        sample = work.cut(_sample(documents, labels, categories, id_col, text_col, max_rows))
        vocabulary = _vocabulary(sample, sample.count())

        def numbers(batches):
            for batch in batches:
                for start, stop, texts in text_runs(batch.column("text"), RUN_CHARS):
                    row, at, _ = numbered(texts, vocabulary)
                    ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                    part = batch.slice(start, stop - start)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))), *(part.column(c) for c in categories)], names=["id", "at", *categories])

        schema = T.StructType([sample.schema["id"], *T.StructType.fromDDL("at array<int>"), *(sample.schema[c] for c in categories)])
        rows = sample.mapInArrow(numbers, schema).withColumn("fold", F.pmod(F.hash("id"), F.lit(FOLDS))).orderBy("id", *categories).toArrow()
    lists = [x.values.to_numpy().astype(np.int64) for x in rows.column("at")]
    truth = np.column_stack([rows.column(c).to_numpy() for c in categories]).astype(float) if len(lists) else np.zeros((0, len(categories)))
    return Chain(categories, vocabulary, lists, truth, rows.column("fold").to_numpy())


def classify(documents: DataFrame, chain: Chain, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``documents`` with p_<category> for each category and <last category> as a decision."""
    bound_batches(documents.sparkSession)
    outs = [f"p_{c}" for c in chain.categories] + [chain.categories[-1]]
    frame = documents.drop(*outs)
    kept = [c for c in frame.columns if keep_text or c != text_col]
    schema = T.StructType([*(frame.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in outs[:-1]), T.StructField(outs[-1], T.BooleanType())])

    def judge(batches):
        for batch in batches:
            for start, stop, texts in text_runs(batch.column(text_col), RUN_CHARS):
                p, decided = chain.predict(texts)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(np.ascontiguousarray(x)) for x in p.T), pa.array(decided)], names=[*kept, *outs])

    return frame.mapInArrow(judge, schema)


CATEGORIES = ["low_quality", "toxic"]


def label_categories(labels: DataFrame) -> DataFrame:
    """The labels table as chain categories: low quality first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = fit(docs, label_categories(spark.read.parquet(f"{sf_dir}/labels.parquet")), CATEGORIES)
    return classify(docs, chain, keep_text=False).select("doc_id", "p_low_quality", "p_toxic", "toxic")
