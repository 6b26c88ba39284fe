"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Benchmark items are cut into windows of 13 words (an item with fewer words is
one window).  The windows of one length form a pattern set with Wu-Manber's
three tables:

* shift: for each block of two words, how far the search may move on;
* buckets: for a block at a window's end, the windows that end so, told apart
  by their first two words and, among these, by a hash of all their words;
* the window of equal hash is compared word by word to confirm an occurrence.

Documents stream past the tables in Arrow batches and are never shuffled.  The
tables travel with the task, which Spark broadcasts.  Items are dealt by hash into
slices of about ``SLICE_CHARS`` characters of benchmark text, and documents pass
one slice after another; each pass is written to the shared folder before the
next slice's tables are made.  So a larger benchmark makes more passes, not a
larger driver, broadcast or plan.

Edge cases: null or wordless documents have no words, no hit, and are not
contaminated.  Null or wordless items have no windows.  Items with equal text
all count.  Item ids that are null are left out of the lists and counts.
Repeated documents each get their row; an empty benchmark contaminates nothing.
Extra columns are kept, those named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.llm.common import bound_batches, cut

WINDOW = 13
SLICE_CHARS = 16_000_000

#: Bytes that end a word become spaces, A-Z become a-z; bytes of 0x80 and above belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
ARROW_OUT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.string())), ("hit_spans", pa.list_(_SPAN))])
OUT_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, hit_spans array<struct<start: int, stop: int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class PatternSet:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, set]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for w, ids in windows.items():
            for stop in range(self.block, length + 1):
                key = w[stop - 2 : stop] if self.block == 2 else w[0]
                self.shift[key] = min(self.shift.get(key, self.far), length - stop)
            self.buckets.setdefault(w[-2:] if self.block == 2 else w[0], {}).setdefault(w[: self.block], {})[w] = frozenset(ids)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, frozenset]]:
        """(start, item ids) of each occurrence."""
        n, length, block = len(words), self.length, self.block
        shift, buckets, far = self.shift.get, self.buckets, self.far
        end = length
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else words[end - 1]
            step = shift(key, far)
            if step:
                end += step
                continue
            start = end - length
            alike = buckets[key].get(tuple(words[start : start + block]))
            if alike and (ids := alike.get(tuple(words[start:end]))) is not None:
                yield start, ids
            end += 1


def build_tables(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[PatternSet]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item_id, text in items:
        words = words_of(text)
        if not words:
            continue
        n = min(window, len(words))
        known = by_length.setdefault(n, {})
        for i in range(len(words) - n + 1):
            known.setdefault(tuple(words[i : i + n]), set()).add(item_id)
    return [PatternSet(n, windows) for n, windows in sorted(by_length.items())]


def _slices(benchmark: DataFrame, id_col: str, text_col: str, slice_chars: int) -> Iterator[tuple[int, bool, list[tuple]]]:
    """(number, whether more follow, items) of each slice."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // slice_chars) if total > slice_chars else 1)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield k, k < n - 1, [(r.i, r.t) for r in part.collect()]


def _passes(frame: DataFrame, tables, first: bool, share: int | None, text_col: str, keep_text: bool) -> DataFrame:
    """One pass of the documents over one slice's tables; the last one (``share`` given) also judges.

    Judging in the same pass keeps it to one Python worker a task.
    """
    names = [c for c in frame.columns if c not in ("_spans", "_items", "_n")]
    kept = [c for c in names if keep_text or c != text_col]
    made_ddl = "_n long, _spans array<int>, _items array<string>" if share is None else OUT_DDL
    schema = T.StructType([frame.schema[c] for c in kept] + list(T.StructType.fromDDL(made_ddl)))

    def scan(batches):
        for batch in batches:
            texts = batch.column(text_col)
            old_spans = [[]] * len(texts) if first else batch.column("_spans").to_pylist()
            old_items = [[]] * len(texts) if first else batch.column("_items").to_pylist()
            counts, spans, found = [], [], []
            for i, text in enumerate(texts):
                words = words_of(text.as_py())
                at, ids = list(old_spans[i]), set(old_items[i])
                for patterns in tables:
                    for start, items in patterns.search(words):
                        at += (start, start + patterns.length)
                        ids |= items
                counts.append(len(words))
                spans.append(at)
                found.append(sorted(x for x in ids if x is not None))
            if share is None:
                made = pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["_n", "_spans", "_items"])
            else:
                made = _judged(counts, spans, found, share)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made.columns], names=[*kept, *made.schema.names])

    return frame.mapInArrow(scan, schema)


def _judged(counts: list[int], spans: list[list[int]], found: list[list[str]], share: int) -> pa.RecordBatch:
    """The output columns of documents, given the starts and stops of their occurrences."""
    rows = []
    for n, at, ids in zip(counts, spans, found, strict=True):
        merged: list[list[int]] = []
        for start, stop in sorted(zip(at[::2], at[1::2], strict=True)):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        hit = sum(b - a for a, b in merged)
        rows.append({"n_words": n, "n_hit": hit, "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "contaminated": hit > 0 and share * hit >= n, "item_ids": ids, "hit_spans": [{"start": a, "stop": b} for a, b in merged]})
    return pa.RecordBatch.from_pylist(rows, schema=ARROW_OUT)


def mark_contamination(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, keep_text: bool = True, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``documents`` with hits, item ids and spans; contaminated: share * n_hit >= n_words and any hit."""
    bound_batches(documents.sparkSession)
    frame = documents.drop(*ARROW_OUT.names, "_n", "_spans", "_items")
    for k, more, items in _slices(benchmark, item_id_col, item_text_col, slice_chars):
        frame = _passes(frame, build_tables(items, window), k == 0, None if more else share, text_col, keep_text or more)
        if more:
            frame = cut(frame)
    return frame


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT dw.rid, dw.n, dw.i, win.item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM occ)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits h ON d.rid = h.rid LEFT JOIN items t ON d.rid = t.rid
"""
