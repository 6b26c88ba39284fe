"""Approximate nearest neighbours by additive quantisation.

A vector is its norm times a unit vector, and the unit vector is approximated by
a sum of ``BOOKS`` codewords, one from each full-dimensional codebook.  The
codebooks start as k-means of successive residuals and are refitted by least
squares on beam-search codes.  Every vector is encoded by beam search and kept
with its codes, its stored norm and its components.

A query, divided by its norm, makes a table of its inner products with all codewords;
a candidate's approximate score is its norm times the sum of its table entries.  Norms
are taken relative to the greatest of their block, and where they span more than
a float holds, scores are compared by sign and logarithm.  Of each block
of candidates the best ``SHORTLIST`` are scored exactly in double precision on
the original vectors, and the best ``k`` of all blocks are merged.

Codebooks are fitted in one task on a hash sample of at most ``SAMPLE`` vectors
(a documented bound); every vector is encoded.  The index is dealt in groups of
about ``GROUP`` rows by hash, and the queries are packed into rows of about
``QUERY_BLOCK`` queries, which meet every group.  The plan is the same for any
number of queries, no query reaches the driver, and each group sends its best
``k`` a query.

Edge cases: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part, nor do rows without an id.
Equal scores rank by the smaller id; scores may overflow to infinity, and those that are no number rank last.  Columns other than id and vector are ignored, whatever their names.  Of
equal vectors in a block only the k + 1 with the smallest ids can be reported,
so a vector that a third of the rows share costs no more than that.  Repeated
ids count once, with their best vector.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larder.llm.common import cut

BOOKS, WORDS, BEAM = 8, 256, 8
SAMPLE, SHORTLIST = 8192, 200
QUERY_BLOCK, BLOCK = 1024, 4096
#: Index rows that one task holds while the query blocks stream past, and groups for tables that would fill few of these.
GROUP, LEAST_GROUPS = 131_072, 64


#: The id of a candidate that is none; no row may have it.
ABSENT = -(2**63)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v as doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0]["n"]) if sizes else rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, keepdims=True)
    length = np.sqrt(((x / scale) ** 2).sum(axis=1))
    with np.errstate(over="ignore"):
        norm = np.minimum(scale[:, 0] * length, np.finfo(float).max)
    return (x / scale / length[:, None]).astype(np.float32), norm


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        count = np.bincount(near, minlength=k)
        by = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[by], np.concatenate(([0], np.cumsum(count[count > 0])[:-1])), axis=0)
        centres[count > 0] = sums / count[count > 0][:, None]
        lost = np.nonzero(count == 0)[0]
        centres[lost] = x[rng.choice(len(x), len(lost))]
    return centres


def encode(unit: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search over the residuals."""
    n, m = len(unit), len(books)
    codes, error = np.zeros((n, 1, m), np.uint8), np.zeros((n, 1))
    residual = unit[:, None, :]
    rows = np.arange(n)[:, None]
    for k, book in enumerate(books):
        gain = error[:, :, None] - 2 * (residual @ book.T) + (book**2).sum(axis=1)
        width = min(beam, gain.shape[1] * gain.shape[2])
        flat = gain.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        source, word = np.divmod(best, len(book))
        codes = codes[rows, source]
        codes[:, :, k] = word
        error = flat[rows, best]
        residual = residual[rows, source] - book[word]
    return codes[np.arange(n), np.argmin(error, axis=1)]


def fit_codebooks(unit: np.ndarray, books: int = BOOKS, words: int = WORDS, refits: int = 2) -> np.ndarray:
    """(books, words, dim) codebooks of a sample of unit vectors."""
    rng = np.random.default_rng(5)
    words = min(words, max(1, len(unit) // 4))
    residual, made = unit.copy(), []
    for _ in range(books):
        book = _k_means(residual, words, rng)
        near = np.argmax(residual @ book.T - 0.5 * (book**2).sum(axis=1), axis=1)
        residual = residual - book[near]
        made.append(book)
    table = np.stack(made).astype(np.float32)
    for _ in range(refits if len(unit) >= 4 * words else 0):
        codes = np.concatenate([encode(unit[i : i + 1024], table) for i in range(0, len(unit), 1024)])
        place = codes.astype(np.int64) + np.arange(books) * words
        hot = np.zeros((len(unit), books * words), np.float32)
        hot[np.arange(len(unit))[:, None], place] = 1
        gram = hot.T @ hot + 0.5 * np.eye(books * words, dtype=np.float32)
        step = np.linalg.solve(gram, hot.T @ (unit - hot @ table.reshape(books * words, -1)))
        table = (table + step.reshape(table.shape)).astype(np.float32)
    return table


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, v, codes, norm) for every valid vector, cut in the shared folder; and the codebooks."""
    rows = cut(valid_vectors(vectors, id_col, vector_col))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)

    def fit(batches):
        parts = [_matrix(b.column("v")) for b in batches if len(b)]
        if parts:
            table = fit_codebooks(_unit(np.concatenate(parts))[0])
            yield pa.RecordBatch.from_arrays([pa.array([list(table.shape)], pa.list_(pa.int32())), pa.array([table.tobytes()], pa.binary())], names=["shape", "table"])

    got = sample.select("v").coalesce(1).mapInArrow(fit, "shape array<int>, table binary").collect()
    if not got:
        return rows.select("vec_id", "v", F.lit(b"").alias("codes"), F.lit(0.0).alias("norm")), None
    books = np.frombuffer(bytes(got[0].table), np.float32).reshape(got[0].shape)

    def code(batches):
        for batch in batches:
            if not len(batch):
                continue
            unit, norm = _unit(_matrix(batch.column("v")))
            codes = np.concatenate([encode(unit[i : i + 512], books) for i in range(0, len(unit), 512)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], names=["vec_id", "v", "codes", "norm"])

    return cut(rows.mapInArrow(code, "vec_id long, v array<double>, codes binary, norm double")), books


def approximate_order(cosine: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Values in the order of ``cosine * norm`` along each row, whatever the norms' range."""
    if norm.min() > norm.max() * 1e-30:
        return cosine * (norm / norm.max()).astype(np.float32)
    size = np.log(np.maximum(np.abs(cosine), np.float32(1e-30)), dtype=float) + np.log(norm)
    return np.sign(cosine) * (size + 1000)  # logarithms of doubles are above -750


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k largest scores, ties to the smaller id; absent candidates come last."""
    order = np.lexsort((ids, -score, ids == ABSENT), axis=1)[:, :k]
    rows = np.arange(len(score))[:, None]
    return score[rows, order], ids[rows, order]


def _without_surplus(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep so that no vector occurs more than ``most`` times; the smallest ids stay."""
    order = np.lexsort((ids, *x.T[::-1]))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return np.sort(order[np.arange(len(x)) - first < most])


def _index_block(held: list[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, ids, codes and norms of some rows of the index, without surplus copies."""
    x = np.concatenate([_matrix(b.column("v")) for b in held])
    ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
    codes = np.concatenate([np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(b), -1) for b in held])
    norm = np.concatenate([b.column("norm").to_numpy() for b in held])
    keep = _without_surplus(x, ids, k + 1)
    return x[keep], ids[keep], codes[keep], norm[keep]


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, matrix): queries (vec_id, v) in about equal blocks by hash, each in one row."""

    def pack(batches):
        at, held = None, []

        def packed():
            x = np.concatenate([_matrix(b.column("v")) for b in held])
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "matrix"])

        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.nonzero(np.diff(block))[0] + 1
            for lo, hi in zip([0, *edges], [*edges, len(block)], strict=True):
                if hi > lo:
                    if held and block[lo] != at:
                        yield packed()
                        held = []
                    at = int(block[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed()

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block int, ids binary, matrix binary")


def _best_of_block(block, books: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, table: np.ndarray, top: tuple, k: int, shortlist: int) -> None:
    """Merges the block's best k for each query into ``top`` (scores, ids)."""
    x, ids, codes, norm = block
    approx = np.zeros((len(queries), len(ids)), np.float32)
    for m in range(len(table)):
        approx += table[m][:, codes[:, m]]
    approx = approximate_order(approx, norm)
    approx[query_ids[:, None] == ids[None, :]] = -np.inf
    width = min(shortlist, len(ids))
    near = np.argpartition(-approx, width - 1, axis=1)[:, :width]
    for at in range(0, len(queries), 64):
        some = slice(at, at + 64)
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.einsum("qd,qrd->qr", queries[some], x[near[some]])
        found = ids[near[some]]
        own = found == query_ids[some][:, None]
        exact, found = np.where(own, -np.inf, exact), np.where(own, ABSENT, found)
        top[0][some], top[1][some] = _best(np.hstack([top[0][some], exact]), np.hstack([top[1][some], found]), k)


def search(index: DataFrame, books: np.ndarray, asked: DataFrame, groups: int, k: int, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, vec_id, score): each index group's best k for each query of the blocks ``asked``.

    A group's rows come first and are held in blocks; query blocks stream past.
    """
    nothing = lambda *columns: [F.lit(None).cast(t).alias(c) for c, t in columns]
    rows = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.lit(-1).alias("block"), "vec_id", "v", "codes", "norm", *nothing(("ids", "binary"), ("matrix", "binary")))
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", *nothing(("vec_id", "long"), ("v", "array<double>"), ("codes", "binary"), ("norm", "double")), "ids", "matrix")
    dealt = rows.unionByName(copies).repartition("g").sortWithinPartitions("g", "block")

    def look(batches):
        at, pending, held = None, [], []
        for batch in batches:
            g, block = batch.column("g").to_numpy(), batch.column("block").to_numpy()
            edges = np.nonzero((np.diff(g) != 0) | (np.diff(block) != 0))[0] + 1
            for lo, hi in zip([0, *edges], [*edges, len(g)], strict=True):
                if lo == hi:
                    continue
                if g[lo] != at:
                    at, pending, held = g[lo], [], []
                if block[lo] < 0:
                    for start in range(lo, hi, BLOCK):
                        pending.append(batch.slice(start, min(BLOCK, hi - start)))
                        if sum(map(len, pending)) >= BLOCK:
                            held.append(_index_block(pending, k))
                            pending = []
                    continue
                if pending:
                    held.append(_index_block(pending, k))
                    pending = []
                for i in range(lo, hi):
                    query_ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                    queries = np.frombuffer(batch.column("matrix")[i].as_py()).reshape(len(query_ids), -1)
                    table = np.einsum("qd,mwd->mqw", _unit(queries)[0], books, optimize=True)
                    top = np.full((len(queries), k), -np.inf), np.full((len(queries), k), ABSENT, np.int64)
                    for part in held:
                        _best_of_block(part, books, query_ids, queries, table, top, k, shortlist)
                    use = top[1] != ABSENT
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, k)[use.ravel()]), pa.array(top[1][use]), pa.array(top[0][use])], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(look, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    index, books = build_index(vectors, id_col, vector_col)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, n_queries = index.count(), queries.count()
    asked = query_blocks(queries, max(1, -(-n_queries // QUERY_BLOCK)))
    groups = max(-(-n // GROUP), min(LEAST_GROUPS, -(-n // BLOCK)))
    found = search(index, books, asked, groups, k, shortlist).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
