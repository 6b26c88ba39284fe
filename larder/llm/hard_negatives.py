"""Hard negatives by a vector-approximation file.

Components are scaled and floored to integers; a row's score for an anchor is the integer
inner product, higher first, ties to the smaller id.  An anchor's positives are its
best ``POSITIVES`` other rows of its label.  For each of them, the negatives are the best
``NEGATIVES`` rows of other labels whose score lies in a window that the positive's
score sets: ``low * positive <= 100 * negative <= high * positive``.

The file: each dimension is cut into 16 cells at quantiles of a hash sample of at most
``SAMPLE`` rows (a documented bound; the cut points decide how tight bounds are, never
what is found).  Every row is kept with its cells, two to a byte, and every
cell with the least and the greatest component that any row has in it, over all
rows.  An anchor makes a table of its least and greatest products with the cells of two dimensions, and a row's
lower and upper score bounds are sums of table entries.  Only rows whose bounds
reach into a window, and beyond the last place found so far, are scored exactly.

Anchors meet all rows, in blocks: the file is dealt into groups of about ``GROUP`` rows by a
hash of the id, and packed blocks of anchors stream past each group.  Positives come
first, as windows hang on their scores, then negatives; a group sends its best few for
each anchor, and their places are settled by one window function.  Copies: of rows with one label and
one vector in a group only the ``POSITIVES + 1`` smallest ids can be reported, so the others are left out
before any anchor comes; a vector that a third of the rows share costs no more.

Edge cases: rows without an id, a label or a vector, with a null or non-finite component,
without components or with another number of them than most take no part (zero vectors do).
Scaled components beyond ``limit(dimensions)``, about 3.8e8 for 64, count as that limit, so that scores fit in a
long.  Of rows that share an id, the one with the least label and vector counts.  Anchors without positives, or positives
without rows in their window, give no rows; nor does a negative positive score.  Columns other than the three
are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larder.llm.common import cut

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
CELLS, SAMPLE = 16, 8192
ANCHOR_BLOCK, ROW_BLOCK, ANCHORS_AT_ONCE = 1024, 4096, 64
#: Rows of the file that one task holds while anchors stream past, and groups for tables that would fill few of these.
GROUP, LEAST_GROUPS = 262_144, 48
_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def limit(dimensions: int) -> int:
    """The greatest component so that no inner product leaves the range of a long."""
    return min(2**31 - 1, int(np.sqrt((2**63 - 1) / dimensions)))


def scaled_rows(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v as ints) of the rows that take part, and how many components they have (0: no rows)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).dropna()
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return rows, 0
    n = sizes[0]["n"]
    most = float(limit(n))
    whole = lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), scale * x))).cast("int")
    return rows.where(F.size("v") == n).withColumn("v", F.transform("v", whole)), n


def _ints(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def cut_points(sample: DataFrame, dimensions: int) -> np.ndarray:
    """(dimensions, CELLS - 1): quantiles of each dimension, found in one task."""

    def fit(batches):
        parts = [_ints(b.column("v"), dimensions) for b in batches if len(b)]
        if parts:
            at = np.quantile(np.concatenate(parts), np.arange(1, CELLS) / CELLS, axis=0, method="lower").T.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel())], names=["at"])

    got = sample.select("v").coalesce(1).mapInArrow(fit, "at long").collect()
    return np.array([r["at"] for r in got], np.int64).reshape(dimensions, CELLS - 1)


def cells_of(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(p, x[:, d], side="right") for d, p in enumerate(points)], axis=1).astype(np.uint8)


def packed_cells(cells: np.ndarray) -> np.ndarray:
    """Two dimensions to a byte; an odd last one is paired with a cell that is always 0."""
    if cells.shape[1] % 2:
        cells = np.pad(cells, ((0, 0), (0, 1)))
    return cells[:, 0::2] * np.uint8(CELLS) + cells[:, 1::2]


def build_file(rows: DataFrame, dimensions: int) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v, cells) of every row, cut in the shared folder; and (2, dimensions, CELLS) extents of the cells over all rows."""
    rows = cut(rows)
    points = cut_points(rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE), dimensions)

    def code(batches):
        for b in batches:
            if len(b):
                codes = packed_cells(cells_of(_ints(b.column("v"), dimensions), points))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "label", "v", "cells"])

    def spans(batches):
        low, high = np.full(dimensions * CELLS, 2**31 - 1), np.full(dimensions * CELLS, -(2**31))
        for b in batches:
            x = _ints(b.column("v"), dimensions)
            place = cells_of(x, points) + np.arange(dimensions) * CELLS
            np.minimum.at(low, place.ravel(), x.ravel())
            np.maximum.at(high, place.ravel(), x.ravel())
        used = np.nonzero(low <= high)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(low[used]), pa.array(high[used])], names=["place", "low", "high"])

    made = cut(rows.mapInArrow(code, "vec_id long, label long, v array<int>, cells binary"))
    extents = np.zeros((2, dimensions * CELLS), np.int64)
    for r in made.select("v").mapInArrow(spans, "place long, low long, high long").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        extents[:, r["place"]] = r["low"], r["high"]
    return made, extents.reshape(2, dimensions, CELLS)


def bound_tables(anchors: np.ndarray, extents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest products (pairs of dimensions, CELLS * CELLS, anchors) with the cells of two dimensions."""
    products = anchors[None, :, :, None] * extents[:, None]  # (2, anchors, dimensions, CELLS)
    tables = []
    for each in (products.min(axis=0), products.max(axis=0)):
        if each.shape[1] % 2:
            each = np.pad(each, ((0, 0), (0, 1), (0, 0)))
        both = each[:, 0::2, :, None] + each[:, 1::2, None, :]
        tables.append(np.ascontiguousarray(both.reshape(*both.shape[:2], -1).transpose(1, 2, 0)))
    reach = (np.abs(anchors).max(axis=0, initial=0) * np.abs(extents).max(axis=(0, 2))).sum(dtype=float)
    return tuple(t.astype(np.int32 if reach < 2**31 else np.int64) for t in tables)


def score_bounds(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (rows, anchors) by table lookup."""
    found = []
    for table in tables:
        total = table[0][cells[:, 0]]
        part = np.empty_like(total)
        for k in range(1, len(table)):
            np.take(table[k], cells[:, k], axis=0, out=part)
            total += part
        found.append(total)
    return found[0], found[1]


def _exact(x: np.ndarray, anchors: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), np.int64)
    for at in range(0, len(row), 32_768):
        some = slice(at, at + 32_768)
        out[some] = (x[row[some]].astype(np.int64) * anchors[anchor[some]]).sum(axis=1)
    return out


def _places(by: np.ndarray) -> np.ndarray:
    """For sorted keys the place of each within its run."""
    new = np.ones(len(by), bool)
    new[1:] = by[1:] != by[:-1]
    return np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by


class Best:
    """The best k (score, id) of each of n searches so far."""

    def __init__(self, n: int, k: int):
        self.k, self.search, self.score, self.id = k, *(np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n, np.iinfo(np.int64).min)  # the score of the last place, once all are taken

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        search, score, ids = np.concatenate([self.search, search]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, search))
        place = _places(search[order])
        order = order[place < self.k]
        self.search, self.score, self.id = search[order], score[order], ids[order]
        last = _places(self.search) == self.k - 1
        self.floor[self.search[last]] = self.score[last]


def floors(search: np.ndarray, lower: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th greatest lower bound of each search; rows with a smaller upper bound cannot be among its best k."""
    out = np.full(n, np.iinfo(np.int64).min)
    order = np.lexsort((-lower, search))
    kth = order[_places(search[order]) == k - 1]
    out[search[kth]] = lower[kth]
    return out


class Group:
    """Rows of one group of the file: one for each id, without copies that cannot be reported, by label."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], copies: int):
        ids, label, x, cells = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((*x.T[::-1], label, ids))
        order = order[_places(ids[order]) == 0]
        order = order[np.lexsort((ids[order], *x[order].T[::-1], label[order]))]
        same = (label[order][1:] == label[order][:-1]) & (x[order][1:] == x[order][:-1]).all(axis=1)
        run = np.cumsum(np.concatenate(([True], ~same)))
        order = order[_places(run) < copies]
        self.ids, self.label, self.x, self.cells = ids[order], label[order], x[order], cells[order]

    def blocks(self, first: int = 0, last: int | None = None) -> Iterator[slice]:
        last = len(self.ids) if last is None else last
        for at in range(first, last, ROW_BLOCK):
            yield slice(at, min(at + ROW_BLOCK, last))

    def positives(self, ids: np.ndarray, label: np.ndarray, anchors: np.ndarray, extents: np.ndarray, k: int) -> Best:
        """The best k other rows of each anchor's label."""
        best = Best(len(ids), k)
        for value in np.unique(label):
            first, last = np.searchsorted(self.label, [value, value + 1])
            mine = np.nonzero(label == value)[0]
            for some in (mine[i : i + ANCHORS_AT_ONCE] for i in range(0, len(mine) if first < last else 0, ANCHORS_AT_ONCE)):
                tables = bound_tables(anchors[some], extents)
                for rows in self.blocks(first, last):
                    lower, upper = score_bounds(self.cells[rows], tables)
                    row, a = np.nonzero((upper >= best.floor[some]) & (self.ids[rows, None] != ids[some]))
                    keep = upper[row, a] >= floors(a, lower[row, a], len(some), k)[a]
                    row, a = row[keep] + rows.start, some[a[keep]]
                    best.add(a, _exact(self.x, anchors, row, a), self.ids[row])
        return best

    def negatives(self, label: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, extents: np.ndarray, k: int) -> Best:
        """The best k rows of another label in each window (anchors, windows); a search is an anchor's number times the windows plus the window's."""
        windows = low.shape[1]
        best = Best(low.size, k)
        for at in range(0, len(label), ANCHORS_AT_ONCE):
            some = np.arange(at, min(at + ANCHORS_AT_ONCE, len(label)))
            tables = bound_tables(anchors[some], extents)
            widest = low[some].min(axis=1), high[some].max(axis=1)
            for rows in self.blocks():
                lower, upper = score_bounds(self.cells[rows], tables)
                row, a = np.nonzero((upper >= widest[0]) & (lower <= widest[1]) & (self.label[rows, None] != label[some]))
                lower, upper = lower[row, a].astype(np.int64), upper[row, a].astype(np.int64)
                wanted, member = np.zeros(len(row), bool), []
                for w in range(windows):
                    search = some[a] * windows + w
                    certain = (lower >= low[some[a], w]) & (upper <= high[some[a], w])
                    least = np.maximum(floors(search[certain], lower[certain], low.size, k), best.floor)
                    member.append((upper >= low[some[a], w]) & (lower <= high[some[a], w]) & (upper >= least[search]))
                    wanted |= member[-1]
                score = np.zeros(len(row), np.int64)
                score[wanted] = _exact(self.x, anchors, row[wanted] + rows.start, some[a[wanted]])
                for w in range(windows):
                    use = np.nonzero(member[w] & (score >= low[some[a], w]) & (score <= high[some[a], w]))[0]
                    best.add(some[a[use]] * windows + w, score[use], self.ids[row[use] + rows.start])
        return best


def windows_of(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score for each positive score; in Python's integers, as the products may leave the range of a long."""
    p = positive.astype(object)
    return (-(-p * low // 100)).astype(np.int64), (p * high // 100).astype(np.int64)


def anchor_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """(block, asked): anchors (vec_id, label, v, positives) in about equal blocks by hash, each in one row."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // ANCHOR_BLOCK)))).cast("int")
    return anchors.groupBy(block.alias("block")).agg(F.collect_list(F.struct("vec_id", "label", "v", "positives")).alias("asked"))


def search(file: DataFrame, extents: np.ndarray, blocks: DataFrame, groups: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Each group's best for each anchor: positives where the anchors have none yet, else negatives for each of them."""
    dimensions = extents.shape[1]
    asked = blocks.schema["asked"].dataType.simpleString()
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    rows = file.select(group.alias("g"), F.lit(-1).alias("block"), "vec_id", "label", "v", "cells", F.lit(None).cast(asked).alias("asked"))
    nothing = (F.lit(None).cast(t).alias(c) for c, t in file.dtypes)
    copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", *nothing, "asked")
    dealt = rows.unionByName(copies).repartition("g").sortWithinPartitions("g", "block")
    narrow = np.int16 if np.abs(extents).max() < 2**15 else np.int32

    def answer(group: Group, some: pa.StructArray):
        ids, label = (some.field(c).to_numpy() for c in ("vec_id", "label"))
        v = _ints(some.field("v"), dimensions).astype(np.int64)
        known = some.field("positives")
        counts = known.value_lengths().to_numpy()
        if not counts.any():
            best = group.positives(ids, label, v, extents, positives)
            blank = pa.nulls(len(best.id), pa.int64())
            return [pa.array(ids[best.search]), blank, blank, pa.array(best.id), pa.array(best.score)]
        width = counts.max()
        at = np.repeat(np.arange(len(ids)), counts), np.concatenate([np.arange(c) for c in counts])
        pos_id, pos_score = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
        pos_id[at], pos_score[at] = known.flatten().field("id").to_numpy(), known.flatten().field("score").to_numpy()
        least, most = np.ones_like(pos_id), np.zeros_like(pos_id)  # no window
        least[at], most[at] = windows_of(pos_score[at], low, high)
        best = group.negatives(label, v, least, most, extents, negatives)
        a, w = np.divmod(best.search, width)
        return [pa.array(c) for c in (ids[a], pos_id[a, w], pos_score[a, w], best.id, best.score)]

    def look(batches):
        at, parts, group = None, [], None
        for batch in batches:
            g, block = batch.column("g").to_numpy(), batch.column("block").to_numpy()
            edges = np.nonzero((np.diff(g) != 0) | (np.diff(block) != 0))[0] + 1
            for lo, hi in zip([0, *edges], [*edges, len(g)], strict=True):
                if lo == hi:
                    continue
                if g[lo] != at:
                    at, parts, group = g[lo], [], None
                part = batch.slice(lo, hi - lo)
                if block[lo] < 0:
                    cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(hi - lo, -1)
                    parts.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _ints(part.column("v"), dimensions).astype(narrow), cells))
                    continue
                if parts:
                    group, parts = Group(parts, positives + 1), []
                for i in range(hi - lo if group else 0):
                    yield pa.RecordBatch.from_arrays(answer(group, part.column("asked")[i].values), names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return dealt.mapInArrow(look, _FOUND)


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is a condition on ``vec_id``."""
    rows, dimensions = scaled_rows(vectors, label, id_col, vector_col, scale)
    if not dimensions:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    file, extents = build_file(rows, dimensions)
    anchors = file.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    n, n_anchors = file.count(), anchors.count()
    groups = max(-(-n // GROUP), min(LEAST_GROUPS, -(-n // ROW_BLOCK)), 1)
    pair = "array<struct<id:bigint,score:bigint>>"
    first = anchor_blocks(anchors.withColumn("positives", F.array().cast(pair)), n_anchors)
    near = search(file, extents, first, groups, positives, negatives, low, high)
    near = ranked(near.select("anchor_id", "vec_id", "score"), ["anchor_id"], positives).where("score >= 0")
    known = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("positives"))
    second = anchor_blocks(cut(anchors.join(known.withColumn("positives", F.col("positives").cast(pair)), "vec_id")), n_anchors)
    found = ranked(search(file, extents, second, groups, positives, negatives, low, high), ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


OP11_SQL = """
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM parts a JOIN parts r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
placed AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM placed WHERE rank <= 3
"""
