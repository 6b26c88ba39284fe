"""Language identification by interpolated Kneser-Ney character models.

For each language a character model of order ``ORDER`` is trained on labelled
texts.  Texts are lower-cased, every run of characters that are not letters
becomes one space, and every letter is a symbol if it is among the ``LETTERS``
most frequent ones of some language, so each script has its own; other letters
share one symbol.  A model holds, for each order, the sorted 64-bit hashes of
its n-grams and of its contexts with their log probabilities and back-off
weights; lookups are binary searches.  A text gets the language with the lowest
mean cross-entropy per character.

Rejection is calibrated on labelled texts that the models have not seen, whole
and scored in one Spark pass: a text is rejected if it has no letter or if its
cross-entropy lies more than ``REJECT_SLACK`` above what ``REJECT_SHARE`` of its
language's calibration texts (of ``LONG`` symbols or more) reach, and by more
than a margin that shrinks with the text's length.  A language without such
texts takes the highest limit of the others.  The score is the probability that
the decision is right, a logistic function of the gap to the runner-up fitted on
the calibration texts.

Counting n-grams and scoring run in Arrow batches.  The labelled texts used are
hash samples of at most about ``max_texts`` distinct texts for training and as many for
calibration of each language (a documented bound; of fewer texts a fifth
calibrates).  Ids play no part in the draw: they may be null, equal or repeated.  N-gram counts are summed by Spark.  The models are bounded by the
sample and not by the input, and travel with the task.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and
are rejected.  Null labels teach nothing.  With no labelled text at all every
text is ``und``.  Languages that fit equally well are decided for the first by
name.  Repeated rows are scored alike.  Extra columns are kept, those named as
an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from larder.llm.common import Scratch, bound_batches, text_runs

ORDER = 4
LETTERS = 1000  #: of each language
BITS = 12  #: of a symbol; four make an n-gram's code
MAX_SYMBOLS = (1 << BITS) - 2
MAX_TEXTS = 6000
REJECT_SHARE, REJECT_SLACK, REJECT_MARGIN, LONG = 0.999, 0.8, 6.0, 200
BATCH_CHARS = 250_000
#: N-grams whose losses a worker remembers.
REMEMBERED = 1_000_000
_U = np.uint64


def _hashed(order: int, codes: np.ndarray) -> np.ndarray:
    x = codes * _U(8) + _U(order)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_IS_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _IS_LETTER[0]


def symbol_table(letters: list[int]) -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, 1 for rare letters, then the alphabet."""
    table = letter_table().astype(np.uint16)
    for k, c in enumerate(letters):
        table[c] = k + 2
    return table


def symbols_of(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each text led by one space and with single spaces; and where each text starts."""
    points = [code_points(t) if t else np.empty(0, np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.zeros(starts[-1], np.uint16)
    for p, s in zip(points, starts, strict=False):
        flat[s + 1 : s + 1 + len(p)] = table[p]
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    keep[starts[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return flat[keep], kept[starts]


def grams_of(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The code of the n-gram that ends at each symbol; what would reach before the first text is space."""
    code = np.zeros(len(symbols), np.uint64)
    for back in range(order - 1, -1, -1):
        code <<= _U(BITS)
        code[back:] |= symbols[: len(symbols) - back] if back else symbols
    return code


def _last(codes: np.ndarray, k: int) -> np.ndarray:
    """The codes of the last k symbols."""
    return codes & _U((1 << (BITS * k)) - 1)


def text_grams(symbols: np.ndarray, starts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of each text, none of them reaching into the text before; and where each text starts."""
    code = grams_of(symbols, order)
    for k in range(order - 1):  # near a start only what belongs to the text counts
        at = starts[:-1] + k
        at = at[at < starts[1:]]
        code[at] = _last(code[at], k + 1)
    keep = np.ones(len(code), bool)
    keep[starts[:-1]] = False  # the leading space is given
    kept = np.concatenate(([0], np.cumsum(keep)))
    return code[keep], kept[starts]


class CharModel:
    """One language's model: sorted hashes with log probabilities, and contexts with back-off weights."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        level: list[tuple[np.ndarray, np.ndarray]] = [(codes, counts.astype(float))]
        for k in range(order - 1, 0, -1):  # lower orders count the distinct symbols before
            shorter, n = np.unique(_last(level[0][0], k), return_counts=True)
            level.insert(0, (shorter, n.astype(float)))
        self.grams, self.contexts = [], []
        for k, (gram, n) in enumerate(level, 1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
            context, place = np.unique(gram >> _U(BITS), return_inverse=True)
            total = np.bincount(place, n)
            weight = discount * np.bincount(place) / total
            lower = np.exp(self._log(k - 1, _last(gram, k - 1)))
            logp = np.log(np.maximum(n - discount, 1e-9) / total[place] + weight[place] * lower)
            self.grams.append(self._sorted(k, gram, logp))
            self.contexts.append(self._sorted(k, context, np.log(weight)))

    @staticmethod
    def _sorted(order: int, codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = _hashed(order, codes)
        by = np.argsort(key)
        return key[by], values[by].astype(np.float32)

    @staticmethod
    def _find(held: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(held[0], key), len(held[0]) - 1)
        return held[0][at] == key, held[1][at]

    def _log(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of n-grams of order k."""
        if k == 0:
            return np.full(len(codes), -BITS * np.log(2))
        seen, value = self._find(self.grams[k - 1], _hashed(k, codes))
        out = value.astype(float)
        if not seen.all():
            miss = codes[~seen]
            known, weight = self._find(self.contexts[k - 1], _hashed(k, miss >> _U(BITS)))
            out[~seen] = np.where(known, weight, 0) + self._log(k - 1, _last(miss, k - 1))
        return out

    def losses(self, codes: np.ndarray) -> np.ndarray:
        return -self._log(self.order, codes)


class Scorer:
    """Mean losses of texts under all models; the losses of n-grams met before are remembered, up to REMEMBERED."""

    def __init__(self, letters: list[int], models: list[CharModel]):
        self.table, self.models = symbol_table(letters), models
        self._forget()

    def _forget(self) -> None:
        self.codes, self.held = np.empty(0, np.uint64), np.empty((0, len(self.models)), np.float32)

    def _losses(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct n-grams, models) losses, and the place of each of ``codes`` among them."""
        place, distinct = pd.factorize(codes)
        at = np.searchsorted(self.codes, distinct)
        known = self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] == distinct if len(self.codes) else np.zeros(len(distinct), bool)
        out = np.empty((len(distinct), len(self.models)), np.float32)
        out[known] = self.held[at[known]]
        if not known.all():
            new = distinct[~known]
            for k, model in enumerate(self.models):
                out[~known, k] = model.losses(new)
            if len(self.codes) + len(new) > REMEMBERED:
                self._forget()
            codes = np.concatenate([self.codes, new])
            by = np.argsort(codes, kind="stable")
            self.codes, self.held = codes[by], np.concatenate([self.held, out[~known]])[by]
        return out, place

    def mean_losses(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, models) mean loss per character, and the number of characters; 0 where a text has no letter."""
        symbols, starts = symbols_of(texts, self.table)
        letters = np.add.reduceat((symbols != 0).astype(np.int64), starts[:-1]) if len(texts) else np.empty(0, np.int64)
        codes, starts = text_grams(symbols, starts)
        n = np.where(letters > 0, np.diff(starts), 0)
        means = np.zeros((len(texts), len(self.models)))
        full = np.nonzero(n)[0]
        if len(full):
            losses, place = self._losses(codes)
            for k in range(len(self.models)):
                sums = np.concatenate(([0.0], np.cumsum(losses[:, k][place], dtype=float)))
                means[full, k] = (sums[starts[full + 1]] - sums[starts[full]]) / n[full]
        return means, n


def labelled_rows(documents: DataFrame, text_col: str, lang_col: str, learn: Column, max_texts: int) -> DataFrame:
    """(lang, text, trains): about ``max_texts`` distinct texts of each language at most that train, and as many that calibrate, drawn by a hash of the text."""
    rows = documents.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit("draw")).alias("hash"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    train, until = F.lit(0.0), F.lit(0.0)
    for lang, n in sizes.items():
        share = min(max_texts / n, 0.8) if n >= 5 else 1.0
        train = F.when(F.col("lang") == lang, F.lit(share)).otherwise(train)
        until = F.when(F.col("lang") == lang, F.lit(share + max_texts / n)).otherwise(until)
    rows = rows.withColumn("draw", F.pmod("hash", F.lit(1 << 30)) / (1 << 30)).where(F.col("draw") < until)
    return rows.dropDuplicates(["lang", "text"]).select("lang", "text", (F.col("draw") < train).alias("trains"))


def _counted_letters(rows: DataFrame) -> list[int]:
    """The letters that are among the LETTERS most frequent ones of a language, frequent ones first; at most MAX_SYMBOLS."""

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                total = np.zeros(0x110000, np.int64)
                for text, of in zip(batch.column("text"), langs, strict=True):
                    if of == lang:
                        n = np.bincount(code_points(text.as_py()))
                        total[: len(n)] += n
                found = np.nonzero(total * letter_table())[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(total[found])], names=["lang", "letter", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, letter long, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "letter"))
    kept = counted.withColumn("place", place).where(F.col("place") <= LETTERS).groupBy("letter").agg(F.sum("n").alias("n"))
    return [r.letter for r in kept.orderBy(F.desc("n"), "letter").limit(MAX_SYMBOLS).collect()]


def _counted_grams(rows: DataFrame, letters: list[int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the codes of its n-grams and their counts (bounded by the sample)."""

    def count(batches):
        table = symbol_table(letters)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                texts = [t.as_py() for t, of in zip(batch.column("text"), langs, strict=True) if of == lang]
                codes, _ = text_grams(*symbols_of(texts, table))
                gram, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    gram, n = got.column("gram").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    langs = got.column("lang").combine_chunks().dictionary_encode()
    code, out = langs.indices.to_numpy(), {}
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        out[lang] = gram[code == k], n[code == k]
    return out


def _decisions(means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language and its lead over the next."""
    best = np.argmin(means, axis=1)
    if means.shape[1] < 2:
        return best, np.full(len(means), 1.0)
    two = np.partition(means, 1, axis=1)
    return best, two[:, 1] - two[:, 0]


class Identifier:
    """Fitted models with their calibration; :meth:`predict` judges a list of texts."""

    def __init__(self, letters: list[int], langs: list[str], models: list[CharModel]):
        self.letters, self.langs, self.models = letters, langs, models
        self.limits = np.full(len(langs), np.inf)
        self.slope, self.shift = 8.0, 0.0
        self._scorer = None

    def calibrate(self, truth: np.ndarray, best: np.ndarray, lead: np.ndarray, loss: np.ndarray, n: np.ndarray) -> None:
        """Limits and score curve from texts of known languages: their decisions, leads, losses and lengths."""
        for k in range(len(self.langs)):
            own = loss[(truth == k) & (best == k) & (n >= LONG)]
            if len(own):
                self.limits[k] = np.quantile(own, REJECT_SHARE) + REJECT_SLACK
        if np.isfinite(self.limits).any():
            self.limits[np.isinf(self.limits)] = self.limits[np.isfinite(self.limits)].max()
        right, w, b, x = (best == truth).astype(float), 8.0, 0.0, lead
        for _ in range(200 if len(x) else 0):  # logistic fit of "right" on the lead, with a weak pull to the start
            p = 1 / (1 + np.exp(-np.clip(w * x + b, -40, 40)))
            w -= 2.0 * (((p - right) * x).mean() + 1e-3 * (w - 8))
            b -= 2.0 * ((p - right).mean() + 1e-3 * b)
        self.slope, self.shift = max(w, 0.1), b

    def scorer(self) -> Scorer:
        if self._scorer is None:
            self._scorer = Scorer(self.letters, self.models)
        return self._scorer

    def decide(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Best language, its lead, its loss and the number of symbols (0: no letter) of each text."""
        means, n = self.scorer().mean_losses(texts)
        best, lead = _decisions(means)
        return best, lead, means[np.arange(len(texts)), best], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, lead, loss, n = self.decide(texts)
        score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(self.slope * lead + self.shift, -40, 40))), 0.0)
        rejected = (n == 0) | (loss > self.limits[best] + REJECT_MARGIN / np.sqrt(np.maximum(n, 1)))
        return [self.langs[k] if m else "und" for k, m in zip(best, n, strict=True)], score, rejected


def fit(documents: DataFrame, *, learn: Column, text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS) -> Identifier:
    """Models of every language among the rows for which ``learn`` holds."""
    bound_batches(documents.sparkSession)
    with Scratch(documents.sparkSession) as work:
        rows = work.cut(labelled_rows(documents, text_col, lang_col, learn, max_texts))
        train = rows.where("trains")
        letters = _counted_letters(train)
        counted = _counted_grams(train, letters)
        langs = sorted(counted)
        model = Identifier(letters, langs, [CharModel(*counted[x]) for x in langs])

        def decide(batches):
            place = {x: k for k, x in enumerate(langs)}
            for batch in batches:
                for start, stop, texts in text_runs(batch.column("text"), BATCH_CHARS):
                    best, lead, loss, n = model.decide(texts)
                    truth = np.array([place.get(x.as_py(), -1) for x in batch.column("lang").slice(start, stop - start)])
                    use = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (truth, best, lead, loss, n)], names=["truth", "best", "lead", "loss", "n"])

        if langs:
            got = rows.where("not trains").select("lang", "text").mapInArrow(decide, "truth long, best long, lead double, loss double, n long").toArrow()
            model.calibrate(*(got.column(c).to_numpy() for c in ("truth", "best", "lead", "loss", "n")))
    return model


def identify(documents: DataFrame, model: Identifier, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``documents`` with lang_pred, score and rejected (columns of these names are replaced)."""
    bound_batches(documents.sparkSession)
    frame = documents.drop("lang_pred", "score", "rejected")
    kept = [c for c in frame.columns if keep_text or c != text_col]
    schema = T.StructType([*(frame.schema[c] for c in kept), *T.StructType.fromDDL("lang_pred string, score double, rejected boolean")])
    model._scorer = None

    def judge(batches):
        for batch in batches:
            for start, stop, texts in text_runs(batch.column(text_col), BATCH_CHARS):
                lang, score, rejected = model.predict(texts)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*kept, "lang_pred", "score", "rejected"])

    return frame.mapInArrow(judge, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, learn=~held_out())
    found = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
