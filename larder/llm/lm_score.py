"""Cross-entropy difference of matched n-gram models.

Two interpolated bigram models share one vocabulary: one of the target texts,
one of the background, which is every text.  Their counts come from the same
pass, and the background's are scaled to the target's size, so smoothing acts on
both alike.  A document's score is the mean over its tokens of the target loss
minus the background loss: the lower, the more the text is like the target.  In
:func:`score_corpus` a text's own counts are left out of the models that score
it.

A model's probability of a word w after v is s * c(v, w) / c(v) + (1 - s) * u(w),
with s = BIGRAM_SHARE * c(v) / (c(v) + CONTEXT_PULL), c(v) the number of words
that follow v, and u(w) = (c(w) + UNIGRAM_FLOOR) / (n + UNIGRAM_FLOOR * (V + 1)).
Every word of the corpus is a symbol of the vocabulary of V words, whatever its
count, and one more symbol stands for words that no text holds, so each model's
probabilities sum to one.

Counts are exact and grow with the corpus.  Texts are tokenised once and kept as
batches of about ``BATCH_TOKENS`` word numbers.  Each batch sends the distinct
n-grams that it holds, as sorted 64-bit hashes with their counts, to the parts of
the hash range (as many as the corpus needs); each part sums what it gets from all
batches, and sends each batch the totals of its n-grams in the order that they
came in.  An n-gram that every text holds thus costs one entry a batch.  Hashes
travel as compressed differences, and totals without the batch's own counts, so
most are zero.  Nothing of the corpus but four sums reaches the driver.  Of 10^8
n-grams two share a hash of 60 bits with probability 4e-3.

Edge cases: null texts and texts without words have no tokens, and null scores.
Label rows with null ids or null values mark no target.  Repeated labels count
once.  If no text is a target, both models are the background and scores are 0.
Repeated documents are counted and scored as often as they occur.  A text longer
than a batch is a batch of its own.  An empty table gives no rows.  Extra columns
are kept, those named as an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.llm.common import Scratch, bound_batches, cut, mixed, run_hashes, runs_of, small_side

BIGRAM_SHARE, CONTEXT_PULL, UNIGRAM_FLOOR = 0.6, 5.0, 0.5
BATCH_TOKENS, RUN_CHARS = 800_000, 1_000_000
#: Bits of the hashes of n-grams; the first ones tell the part.
HASH_BITS = 60
#: Part sizes follow from this many tokens for each part of the hash range.
TOKENS_PER_PART = 1_500_000
#: Of each n-gram its number, and the number of words that follow it (0 for pairs), in all texts and in the target's.
COUNTS = ["n_all", "after_all", "n_target", "after_target"]
PART_DDL = "p int, batch long, grams binary, " + ", ".join(f"{c} binary" for c in COUNTS)
OUTS = ["n_tokens", "target_loss", "background_loss", "score"]
_U = np.uint64
_START = _U(0x5DEECE66D)
_ALNUM: list[np.ndarray] = []


def alnum_table() -> np.ndarray:
    """Which code points belong to words."""
    if not _ALNUM:
        _ALNUM.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    return _ALNUM[0]


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of ``texts`` in order, and each text's number of words."""
    units, starts, stops, lengths = runs_of(texts, alnum_table())
    return run_hashes(units, starts, stops), lengths


def packed(x: np.ndarray) -> bytes:
    """Compressed planes of bytes of 64-bit integers."""
    planes = np.ascontiguousarray(x.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<i8")


def packed_hashes(x: np.ndarray) -> bytes:
    """Sorted hashes by their differences."""
    return packed(np.diff(x.view(np.int64), prepend=0))


def unpacked_hashes(raw) -> np.ndarray:
    return np.cumsum(unpacked(raw)).view(np.uint64)


class Grams:
    """The distinct n-grams of one batch by number and by hash: its words with the start symbol, and its pairs."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, lengths: np.ndarray):
        self.n_words, self.ids = len(words), ids
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.before = np.concatenate(([self.n_words], ids[:-1]))[: len(ids)]
        self.before[(np.cumsum(lengths) - lengths)[lengths > 0]] = self.n_words
        self.pairs, self.pair = np.unique(self.before * (self.n_words + 1) + ids, return_inverse=True)
        symbols = np.append(words, _START)
        prev, word = np.divmod(self.pairs, self.n_words + 1)
        hashes = np.concatenate([mixed(symbols), mixed(mixed(symbols[prev] ^ _U(0xA24BAED4963EE407)) * _U(0x9FB21C651E98DF25) + symbols[word])]) >> _U(64 - HASH_BITS)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def counts(self, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How often the batch has each n-gram, and how often a word follows it, in the order of the hashes."""
        n = [np.bincount(self.ids, weight, self.n_words + 1), np.bincount(self.pair, weight, len(self.pairs))]
        after = [np.bincount(self.before, weight, self.n_words + 1), np.zeros(len(self.pairs))]
        return tuple(np.concatenate(x).astype(np.int64)[self.order] for x in (n, after))

    def spread(self, n: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        """Totals in the order of the hashes, as one for each token: of its word, of words after its context, and of its pair."""
        by_number = np.empty((2, len(n)), np.int64)
        by_number[0, self.order], by_number[1, self.order] = n, after
        return [by_number[0][self.ids], by_number[1][self.before], by_number[0, self.n_words + 1 :][self.pair]]

    def own(self) -> list[np.ndarray]:
        """For each token, how often its own text has its word, its context and its pair."""
        out = []
        for x, n in ((self.ids, self.n_words + 1), (self.before, self.n_words + 1), (self.pair, max(len(self.pairs), 1))):
            place, times = np.unique(self.text * n + x, return_inverse=True, return_counts=True)[1:]
            out.append(times[place])
        return out


def encode(documents: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """Batches of tokenised texts: (batch, words: their hashes, ids: each token's word, docs: the ``kept`` columns, _target and _n of each row)."""
    struct = T.StructType([*(documents.schema[c] for c in kept), *T.StructType.fromDDL("_target boolean, _n long")])
    schema = T.StructType([*T.StructType.fromDDL("batch long, tokens long, target_tokens long, words binary, ids binary"), T.StructField("docs", T.ArrayType(struct))])

    def gather(batches):
        hashes, lengths, rows, number = [], [], [], 0

        def closed():
            nonlocal number
            words, ids, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            by = np.argsort(-n, kind="stable")  # frequent words get small numbers
            turn = np.empty_like(by)
            turn[by] = np.arange(len(by))
            length = np.concatenate(lengths)
            table = pa.Table.from_batches(rows).combine_chunks()
            cols = [table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type) for c in table.column_names]
            target = table.column("_target").to_numpy().astype(bool)
            docs = pa.StructArray.from_arrays([*cols, pa.array(length)], names=[*table.column_names, "_n"])
            out = [pa.array([(TaskContext.get().partitionId() << 40) + number]), pa.array([int(length.sum())]), pa.array([int(length[target].sum())]), pa.array([words[by].tobytes()], pa.binary()), pa.array([packed(turn[ids])], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), docs)]
            number += 1
            hashes.clear(), lengths.clear(), rows.clear()
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            texts, start = batch.column(text_col), 0
            while start < len(batch):
                run, size, stop = [], 0, start
                while stop < len(batch) and size < RUN_CHARS:
                    run.append(texts[stop].as_py())
                    size += len(run[-1] or "")
                    stop += 1
                found = token_hashes(run)
                hashes.append(found[0])
                lengths.append(found[1])
                rows.append(batch.slice(start, stop - start).select([*kept, "_target"]))
                start = stop
                if sum(map(len, hashes)) >= BATCH_TOKENS:
                    yield closed()
        if rows:
            yield closed()

    return documents.mapInArrow(gather, schema)


def _grams_of(row: dict) -> tuple[Grams, pa.StructArray]:
    docs = row["docs"].values
    lengths = docs.field("_n").to_numpy(zero_copy_only=False)
    return Grams(np.frombuffer(row["words"].as_buffer(), np.uint64), unpacked(row["ids"].as_buffer()), lengths), docs


def _rows(batch: pa.RecordBatch):
    for i in range(len(batch)):
        yield {c: batch.column(c)[i] for c in batch.schema.names}


def requests(encoded: DataFrame, bits: int) -> DataFrame:
    """(p, batch, grams and COUNTS): the n-grams of each batch by part of the hash range."""

    def ask(batches):
        for batch in batches:
            for row in _rows(batch):
                grams, docs = _grams_of(row)
                target = docs.field("_target").to_numpy(zero_copy_only=False).astype(float)
                counts = (*grams.counts(), *grams.counts(target[grams.text]))
                part = (grams.hashes >> _U(HASH_BITS - bits)).astype(np.int64)
                edges = [0, *(np.nonzero(np.diff(part))[0] + 1), len(part)]
                spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[a] for a, _ in spans], pa.int32()), pa.array([row["batch"].as_py()] * len(spans), pa.int64()),
                    *(pa.array([make(x[a:b]) for a, b in spans], pa.binary()) for make, x in ((packed_hashes, grams.hashes), *((packed, c) for c in counts))),
                ], names=["p", "batch", "grams", *COUNTS])

    return encoded.select("batch", "words", "ids", "docs").mapInArrow(ask, PART_DDL)


def _parts(asked: DataFrame, work):
    """``work`` on all rows of each part at once; a part's size is bounded by TOKENS_PER_PART."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for row in _rows(batch):
                if held and row["p"].as_py() != at:
                    yield work(held)
                    held = []
                at = row["p"].as_py()
                held.append({c: v.as_py() for c, v in row.items()})
        if held:
            yield work(held)

    return asked.repartition("p").sortWithinPartitions("p", "batch").mapInArrow(run, PART_DDL)


def _summed(held: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct hashes of a part, each entry's place among them, the entries' counts and the hashes' totals."""
    grams, place = np.unique(np.concatenate([unpacked_hashes(r["grams"]) for r in held]), return_inverse=True)
    own = [np.concatenate([unpacked(r[c]) for r in held]) for c in COUNTS]
    return grams, place, own, [np.bincount(place, x, len(grams)).astype(np.int64) for x in own]


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64()] + [pa.binary()] * (1 + len(COUNTS))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["p", "batch", "grams", *COUNTS])


def corpus_totals(asked: DataFrame) -> DataFrame:
    """The requests with what all others count, without the hashes."""

    def answer(held):
        _, place, own, totals = _summed(held)
        ends = np.cumsum([0] + [len(unpacked(r["n_all"])) for r in held])
        return _batch_of([(r["p"], r["batch"], None, *(packed(t[place[a:b]] - x[a:b]) for t, x in zip(totals, own, strict=True))) for r, a, b in zip(held, ends, ends[1:], strict=False)])

    return _parts(asked, answer)


def part_tables(asked: DataFrame) -> DataFrame:
    """One row for each part: its n-grams in order and their totals (batch is null)."""

    def table(held):
        grams, _, _, totals = _summed(held)
        return _batch_of([(held[0]["p"], None, packed_hashes(grams), *map(packed, totals))])

    return _parts(asked, table)


def table_totals(asked: DataFrame, tables: DataFrame) -> DataFrame:
    """The requests with the totals that ``tables`` has for them, without the hashes."""

    def answer(held):
        known = next((r for r in held if r["batch"] is None), None)
        grams = unpacked_hashes(known["grams"]) if known else np.empty(0, np.uint64)
        totals = [np.append(unpacked(known[c]) if known else [], 0).astype(np.int64) for c in COUNTS]
        rows = []
        for r in held:
            if r["batch"] is not None:
                own = unpacked_hashes(r["grams"])
                at = np.searchsorted(grams, own)
                at[np.append(grams, _U(0))[at] != own] = len(grams)
                rows.append((r["p"], r["batch"], None, *(packed(t[at]) for t in totals)))
        return _batch_of(rows) if rows else _batch_of([(0, 0, None, *[None] * len(COUNTS))]).slice(0, 0)

    return _parts(asked.unionByName(tables), answer)


def n_distinct_words(encoded: DataFrame) -> int:
    def words(batches):
        for batch in batches:
            for x in batch.column("words"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], names=["word"])

    return encoded.select("words").mapInArrow(words, "word long").distinct().count()


@dataclass
class Sizes:
    """What of the corpus a model needs beside the counts."""

    bits: int
    n_words: int
    n_all: int
    n_target: int


def sizes_of(encoded: DataFrame) -> Sizes:
    n_all, n_target = encoded.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("target_tokens"), F.lit(0))).first()
    return Sizes((n_all // TOKENS_PER_PART).bit_length(), n_distinct_words(encoded), n_all, n_target)


def token_losses(grams: Grams, totals: list[np.ndarray], n: float, n_words: int, scale: float, own: list[np.ndarray] | None, length: np.ndarray) -> np.ndarray:
    """The loss of each token under one model; ``own`` (None: not counted) is taken out of the model."""
    word, context, pair = (np.maximum(t * scale - (0 if own is None else scale * own[k]), 0.0) for k, t in enumerate(totals))
    left = n - (0 if own is None else scale * length)
    low = (word + UNIGRAM_FLOOR) / (np.maximum(left, 0.0) + UNIGRAM_FLOOR * (n_words + 1))
    share = BIGRAM_SHARE * context / (context + CONTEXT_PULL)
    return -np.log(share * pair / np.maximum(context, 1e-9) + (1 - share) * low)


def losses(encoded: DataFrame, totals: DataFrame, sizes: Sizes, kept: list[str], counted: bool) -> DataFrame:
    """The ``kept`` columns, n_tokens, target_loss, background_loss and score of every row in ``encoded``."""
    docs_type = encoded.schema["docs"].dataType
    schema = T.StructType([*(docs_type.elementType[c] for c in kept), *T.StructType.fromDDL("n_tokens long, target_loss double, background_loss double, score double")])
    nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    replies = totals.select("batch", "p", *COUNTS, *nothing("words", "ids"), F.lit(None).cast(docs_type).alias("docs"))
    bodies = encoded.select("batch", F.lit(1 << 30).alias("p"), *nothing(*COUNTS), "words", "ids", "docs")
    dealt = replies.unionByName(bodies).repartition("batch").sortWithinPartitions("batch", "p")
    n = float(sizes.n_target or sizes.n_all)
    scale = n / max(sizes.n_all, 1)  # the background matched to the target's size

    def judged(row, parts):
        grams, docs = _grams_of(row)
        lengths = docs.field("_n").to_numpy(zero_copy_only=False)
        length = lengths[grams.text]
        target = docs.field("_target").to_numpy(zero_copy_only=False).astype(float)[grams.text]
        spread = {}
        for c, weight in (("all", None), ("target", target)):
            totals = [np.concatenate([np.empty(0, np.int64), *(unpacked(x[f"{kind}_{c}"]) for x in parts)]) for kind in ("n", "after")]
            if counted:
                totals = [x + mine for x, mine in zip(totals, grams.counts(weight), strict=True)]
            spread[c] = grams.spread(*totals)
        own = grams.own() if counted else None
        back = token_losses(grams, spread["all"], n, sizes.n_words, scale, own, length)
        if sizes.n_target:
            own = own and [x * target for x in own]
            front = token_losses(grams, spread["target"], n, sizes.n_words, 1.0, own, length * target)
        else:
            front = back
        full, starts = lengths > 0, (np.cumsum(lengths) - lengths)
        means = [np.full(len(lengths), np.nan) for _ in range(2)]
        if full.any():
            for mean, x in zip(means, (front, back), strict=True):
                mean[full] = np.add.reduceat(x, starts[full]) / lengths[full]
        made = [pa.array(m, pa.float64(), mask=~full) for m in (*means, means[0] - means[1])]
        return pa.RecordBatch.from_arrays([*(docs.field(c) for c in kept), pa.array(lengths), *made], names=schema.names)

    def judge(batches):
        parts = []
        for batch in batches:
            for row in _rows(batch):
                if row["docs"].is_valid:
                    yield judged(row, parts)
                    parts = []
                else:
                    parts.append({c: row[c].as_py() for c in COUNTS})

    return dealt.mapInArrow(judge, schema)


def _marked(documents: DataFrame, target_ids: DataFrame | None, id_col: str) -> DataFrame:
    if target_ids is None:
        return documents.withColumn("_target", F.lit(False))
    flags = cut(target_ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()).withColumn("_target", F.lit(True))
    return documents.join(small_side(flags), id_col, "left").withColumn("_target", F.coalesce("_target", F.lit(False)))


def _prepared(documents: DataFrame, target_ids: DataFrame | None, id_col: str, text_col: str, keep_text: bool) -> tuple[DataFrame, list[str]]:
    bound_batches(documents.sparkSession)
    frame = documents.drop(*OUTS, "_target", "_n")
    kept = [c for c in frame.columns if keep_text or c != text_col]
    return encode(_marked(frame, target_ids, id_col), kept, text_col), kept


def score_corpus(documents: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``documents`` with n_tokens, target_loss, background_loss and score (their difference), under models of all other rows.

    The models are those of the rows whose id is in ``target_ids`` and of all rows.
    """
    encoded, kept = _prepared(documents, target_ids, id_col, text_col, keep_text)
    encoded = cut(encoded)
    sizes = sizes_of(encoded)
    return losses(encoded, corpus_totals(requests(encoded, sizes.bits)), sizes, kept, True)


@dataclass
class MatchedModels:
    """Exact counts of both models by part of the hash range, for scoring other texts."""

    tables: DataFrame
    sizes: Sizes


def fit(documents: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> MatchedModels:
    """Models of the rows whose id is in ``target_ids`` and of all rows."""
    with Scratch(documents.sparkSession) as work:
        encoded = work.cut(_prepared(documents.select(id_col, text_col), target_ids, id_col, text_col, False)[0])
        sizes = sizes_of(encoded)
        return MatchedModels(cut(part_tables(requests(encoded, sizes.bits))), sizes)


def score(documents: DataFrame, models: MatchedModels, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``documents``, which the models have not counted, with n_tokens, target_loss, background_loss and score."""
    encoded, kept = _prepared(documents, None, "", text_col, keep_text)
    encoded = cut(encoded)
    return losses(encoded, table_totals(requests(encoded, models.sizes.bits), models.tables), models.sizes, kept, False)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score_corpus(docs, target, keep_text=False)
