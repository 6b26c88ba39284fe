"""Sequence packing by cutting-stock column generation.

Every document becomes token ids plus one end id and is cut into full sequences
and one remainder.  Remainder lengths, rounded up to classes of ``STEP`` tokens,
form a histogram; a linear program over packing patterns minimises the number of
sequences that hold it.  Its columns are generated: an unbounded-knapsack
dynamic program prices them with the duals.  Full patterns are rounded down, what is
left is filled greedily, and the patterns' slots are assigned to the pieces
by their rank inside their class.

Only the histogram (at most ``CAPACITY / STEP`` rows) reaches the driver, and
only the patterns (bounded by the same number) are broadcast.  Ranks come from
row numbers inside (class, hash bucket) plus the buckets' offsets, so a class
that holds most pieces is spread over many tasks.  Pieces are written once to
the shared folder, and texts are never shuffled.

Edge cases: a null or empty text is the end id alone.  Repeated rows and null
ids are packed like any other row.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from larder.llm.common import bound_batches, cut

CAPACITY, STEP, END_ID = 1024, 4, 0
PIECES_PER_BUCKET = 20_000
#: Longest stretch given to the encoder at once; longer texts are divided where no token can span.
STRETCH = 200_000


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts, for a tokenizer file of the tokenizers library.

    Byte-level BPE vocabularies whose ids are merge ranks are run by tiktoken,
    which gives the same ids several times faster; others by tokenizers.
    Strings of added tokens inside a text are those tokens, as the file has it.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, {t["content"]: t for t in spec.get("added_tokens", [])}
        plain = not any(t.get(flag) for t in added.values() for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain:
            import public_tokenizers

            to_byte, vocab = _byte_alphabet(), spec["model"]["vocab"]
            ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in added}
            merged = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
            if all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merged)):
                self.fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={token: t["id"] for token, t in added.items()})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) <= STRETCH:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.concatenate([self.fast.encode_to_numpy(x, allowed_special="all") for x in stretches(text)])


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """Parts of ``text`` cut before a newline or space that follows a letter and precedes a letter."""
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) - 1 and not (text[at] in " \n" and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at += 1
        if at >= len(text) - 1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Full sequences and one remainder for each document; with the token ids if asked for."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)])
    names = schema.names
    encoder: list[Encoder] = []

    def encode(batches):
        if not encoder:
            encoder.append(Encoder(tokenizer or default_tokenizer()))
        for batch in batches:
            at, made = [], {c: [] for c in names[1:]}
            for i, text in enumerate(batch.column("text")):
                value = text.as_py()
                ids = np.append(encoder[0].ids(value) if value else np.empty(0, np.uint32), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    at.append(i)
                    made["start"].append(start)
                    made["length"].append(len(part))
                    made["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    made["doc_tokens"].append(len(ids))
                    if with_ids:
                        made["ids"].append(part.astype(np.int32))
            cols = [batch.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array(made[c], pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in names[1:]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(encode, schema)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best filling of one sequence: unbounded knapsack by dynamic programming."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if fits:
            gains = values[:fits] + best[c - sizes[:fits]]
            k = int(np.argmax(gains))
            if gains[k] > best[c] + 1e-12:
                best[c], chosen[c] = gains[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            pattern[chosen[c]] += 1
            c -= sizes[chosen[c]]
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse.  Plain array arithmetic: BLAS threads can hang in a driver that has started a JVM."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        top = k + int(np.argmax(np.abs(work[k:, k])))
        if top != k:
            work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        rows = np.nonzero(factor)[0]
        work[rows] -= factor[rows, None] * work[k]
    return work[:, n:]


def first_patterns(sizes: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis: sizes that fill a sequence in twos, and single sizes repeated."""
    basis, place = np.diag((capacity // sizes).astype(float)), {int(s): k for k, s in enumerate(sizes)}
    for s, k in place.items():
        other = place.get(capacity - s)
        if other is not None and s < capacity - s:
            scarce = k if need[k] <= need[other] else other
            basis[:, scarce] = 0
            basis[k, scarce] = basis[other, scarce] = 1
    return basis


def cutting_stock(demand: dict[int, int], capacity: int, max_columns: int = 2000) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: copies}) patterns that hold the demand exactly.

    Stopping the column generation early (``max_columns``) leaves a feasible
    plan with more padding; no piece is lost.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([float(demand[s]) for s in sizes])
    basis = first_patterns(sizes, need, capacity)
    inverse = inverted(basis)
    centre, bound = inverse.sum(axis=0), 0.0
    for step in range(max_columns):
        if step % 50 == 49:
            inverse = inverted(basis)
        times, duals = (inverse * need).sum(axis=1), inverse.sum(axis=0)
        # prices between the best duals so far and the present ones swing less
        mixed = 0.7 * centre + 0.3 * duals
        value, column = price(mixed, sizes, capacity)
        if (worth := (mixed * need).sum() / value) > bound:
            bound, centre = worth, mixed
        if (column * duals).sum() <= 1 + 1e-7:
            value, column = price(duals, sizes, capacity)
            if (worth := (duals * need).sum() / value) > bound:
                bound, centre = worth, duals
            if value <= 1 + 1e-7:
                break
        if times.sum() <= bound * (1 + 1e-4):
            break
        move = (inverse * column).sum(axis=1)
        ratio = np.where(move > 1e-9, np.maximum(times, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
    times = np.floor(np.maximum((inverted(basis) * need).sum(axis=1), 0) + 1e-9).astype(np.int64)
    copies = basis.astype(np.int64)
    left = need.astype(np.int64) - (copies * times).sum(axis=1)
    wasteful = (sizes[:, None] * copies).sum(axis=0) < capacity  # greedy filling can mix their pieces with others
    left += (copies * (times * wasteful)).sum(axis=1)
    times[wasteful] = 0
    for k in range(len(times)):  # rounding noise may have overfilled a class
        while times[k] and (copies[:, k] * (left < 0)).any():
            times[k] -= 1
            left += copies[:, k]
    plan = [(int(times[k]), {int(s): int(n) for s, n in zip(sizes, copies[:, k], strict=True) if n}) for k in range(len(times)) if times[k]]
    while (left > 0).any():
        room, pattern = capacity, {}
        for k in range(len(sizes) - 1, -1, -1):
            n = min(int(left[k]), room // int(sizes[k]))
            if n:
                pattern[k], room = n, room - n * int(sizes[k])
        repeat = min(int(left[k]) // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * repeat
        plan.append((repeat, {int(sizes[k]): n for k, n in pattern.items()}))
    return plan


def slots_of(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, copies, first sequence, first slot) of each pattern and size."""
    rows, base, ranks = [], 0, {}
    for times, pattern in plan:
        slot = 0
        for size, copies in sorted(pattern.items(), reverse=True):
            lo = ranks.get(size, 0)
            ranks[size] = lo + times * copies
            rows.append((size, lo, ranks[size], copies, base, slot))
            slot += copies
        base += times
    return rows


def rank_in_class(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank (from 0) among those of their size class, without one task per class."""
    n = pieces.count()
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(256, n // PIECES_PER_BUCKET)))
    rows = pieces.withColumn("bucket", bucket)
    counts = rows.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    return rows.withColumn("inside", inside).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("inside") + F.col("skip")).drop("inside", "skip", "bucket")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """``pieces`` (length column, at most ``capacity``) with sequence_id and offset."""
    spark = pieces.sparkSession
    sized = pieces.withColumn("size", F.ceil(F.col("length") / step).cast("long"))
    demand = {r["size"]: r["count"] for r in sized.groupBy("size").count().collect()}
    slots = slots_of(cutting_stock(demand, capacity // step))
    table = spark.createDataFrame(slots, "size long, lo long, hi long, copies long, base long, slot long")
    ranked = rank_in_class(sized)
    inside = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(table), "size").where((inside >= 0) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor(inside / F.col("copies"))).withColumn("place", F.col("slot") + inside % F.col("copies"))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select(*pieces.columns, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(documents: DataFrame, **options) -> DataFrame:
    """Pieces of all documents in sequences; options as for :func:`token_pieces`."""
    return pack_pieces(cut(token_pieces(documents, **options)), options.get("capacity", CAPACITY))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
