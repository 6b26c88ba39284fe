"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes) and a
   signature of ``SYMBOLS`` MinHash values of 15 bits, four to a long.
   Documents with equal sets form a class; one row stands for it from here on.
2. Each long of the signature is a chunk.  For ``share`` = 75 one symbol of a
   chunk may differ: two signatures that differ in at most 31 of 64 symbols
   have, by the pigeonhole principle, a chunk with at most one differing symbol.
   Each chunk therefore gives a key for every choice of symbols to leave out,
   and any two signatures within the distance share a key.  For other shares the
   number of symbols left out is derived from the share (``chunk_errors``).
3. In each key's bucket every class is paired with two hubs: the one that meets
   most classes over all its buckets, as the text that others were made from
   does, and the one of the smallest number.  Pairs within the distance are
   confirmed on their full shingle sets, and confirmed links are merged into
   components.
4. What hubs can't show: buckets that still hold more than one component are
   joined with themselves, for pairs of different components only, each in the
   first chunk that it shares, within the distance.  A large bucket is dealt in
   blocks over many tasks.  These pairs are confirmed too and merged.  Pairs
   inside one component are never listed, so a large group of near copies costs
   its size, not its square.

Before two sets are brought together, their bitmaps (``BITMAP`` cells, each set
if a shingle falls into it) bound the intersection from above: a cell that only
one set fills holds a shingle of that set alone.  Pairs whose bound is too low
can't be links, so this drops no pair that confirmation would keep.

Two texts with Jaccard similarity 0.75 differ in 16 of 64 symbols on average,
and in more than 31 with probability 2e-5; that is all that can be missed.
Confirmation is exact up to collisions of 64-bit hashes within a pair.

Texts are read twice, once for the signatures and once for the sets of classes
that share a bucket.  Hubs with many partners are salted.  Components are found
by alternating large-star and small-star steps on tables that are cut in the
shared folder; all cut tables but the result are deleted at the end.

Edge cases: texts that are null or have no word have an empty set and are linked
with nothing.  Texts of fewer than 5 words are one shingle.  Repeated rows and
equal texts share a class.  Rows with one id and different texts are linked each
by its own text.  A null id takes no part in naming a component; its row gets
the component of its class, if that has one.  An empty table gives no rows.
Extra columns are ignored here; join on the id and ``text_hash`` (Spark's
xxhash64 of the text) to get them back.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larder.llm.common import Scratch, bound_batches, cut, mixed, run_hashes

SHINGLE = 5
#: A chunk has four symbols and is one long of the signature.
SYMBOLS, LANES, SYMBOL_BITS = 64, 4, 15
CHUNKS = SYMBOLS // LANES
SIG = [f"s{k}" for k in range(CHUNKS)]
BITMAP = 2048
PARTNERS_PER_SALT = 200
#: Members of an open bucket that meet the whole bucket in one task.
MEMBERS_PER_BLOCK = 256
BATCH_BYTES = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of one text: polynomial over the bytes, then mixed."""
    raw = np.frombuffer(text.translate(_LOWER), np.uint8)
    letter = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    return run_hashes(raw, starts, stops)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    n = len(words)
    if not n:
        return words
    width = min(SHINGLE, n)
    rolled = np.full(n - width + 1, _U(width), np.uint64)
    for k in range(width):
        rolled = mixed(rolled * _U(0x2545F4914F6CDD1D) + words[k : n - width + 1 + k])
    return np.unique(rolled)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash symbols of each non-empty set, a chunk to a long: (sets, chunks) int64."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    packed = np.zeros((len(sets), CHUNKS), np.int64)
    odd = np.random.default_rng(7).integers(1, 1 << 63, SYMBOLS, np.uint64) * _U(2) + _U(1)
    values, turned = np.empty_like(flat), np.empty_like(flat)
    for k in range(SYMBOLS):
        np.multiply(flat, odd[k], out=values)
        np.right_shift(values, _U(29), out=turned)
        np.bitwise_xor(values, turned, out=values)
        low = mixed(np.minimum.reduceat(values, starts)) & _U((1 << SYMBOL_BITS) - 1)
        packed[:, k // LANES] |= low.astype(np.int64) << np.int64(SYMBOL_BITS * (k % LANES))
    return packed


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The cells that a set fills, 64 to a long."""
    cells = np.zeros(BITMAP, np.uint8)
    cells[(mixed(shingles ^ _U(0x5851F42D4C957F2D)) % _U(BITMAP)).astype(np.int64)] = 1
    return np.packbits(cells, bitorder="little").view(np.int64)


def _text_runs(texts: pa.Array):
    """(start, stop, shingle sets) for runs of about BATCH_BYTES characters."""
    start = 0
    while start < len(texts):
        sets, size, stop = [], 0, start
        while stop < len(texts) and size < BATCH_BYTES:
            text = texts[stop].as_py()
            size += len(text or "")
            sets.append(shingle_set(text))
            stop += 1
        yield start, stop, sets
        start = stop


def shingle_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, the set's 128-bit fingerprint (f0, f1) and the signature."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T.StructType.fromDDL("text_hash long, n_shingles long, f0 long, f1 long, " + ", ".join(f"{s} long" for s in SIG))])

    def sketch(batches):
        for batch in batches:
            for start, stop, sets in _text_runs(batch.column("text")):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.nonzero(n)[0]
                sig, f = np.zeros((len(sets), CHUNKS), np.int64), np.zeros((2, len(sets)), np.int64)
                if len(full):
                    sig[full] = signatures([sets[i] for i in full])
                    flat = np.concatenate(sets)
                    at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    f[0, full] = np.add.reduceat(mixed(flat), at).view(np.int64)
                    f[1, full] = np.bitwise_xor.reduceat(mixed(flat + _U(0xD1B54A32D192ED03)), at).view(np.int64)
                own = [batch.column(c).slice(start, stop - start) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(f[0]), pa.array(f[1]), *(pa.array(sig[:, k]) for k in range(CHUNKS))], names=schema.names)

    return rows.mapInArrow(sketch, schema)


def set_table(texts: DataFrame) -> DataFrame:
    """(cid, shingles: the sorted set as bytes, bits: its bitmap) for rows (cid, text)."""

    def gather(batches):
        for batch in batches:
            for start, stop, sets in _text_runs(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(start, stop - start), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], names=["cid", "shingles", "bits"])

    return texts.select("cid", "text").mapInArrow(gather, "cid long, shingles binary, bits array<long>")


def chunk_errors(share: int) -> int:
    """How many symbols of a chunk may differ, so that pairs of this similarity lie within the distance by four standard deviations."""
    apart = 1 - share / 100
    far = SYMBOLS * apart + 4 * (SYMBOLS * apart * (1 - apart)) ** 0.5
    return next((e for e in range(LANES - 1) if max_distance(e) >= far), LANES - 1)


def max_distance(errors: int) -> int:
    """All pairs of signatures that differ in at most so many symbols share a key."""
    return CHUNKS * (errors + 1) - 1


def signature_keys(classes: DataFrame, errors: int) -> DataFrame:
    """(key, chunk, choice, cid): each class once for every chunk and choice of symbols to keep."""
    masks = [sum(((1 << SYMBOL_BITS) - 1) << (SYMBOL_BITS * x) for x in kept) for kept in combinations(range(LANES), LANES - errors)]
    keys = [F.struct(F.xxhash64(F.lit(k), F.lit(c), F.col(s).bitwiseAND(F.lit(mask))).alias("key"), F.lit(k).cast("byte").alias("chunk"), F.lit(c).cast("byte").alias("choice")) for k, s in enumerate(SIG) for c, mask in enumerate(masks)]
    return classes.select("cid", F.explode(F.array(*keys)).alias("_k")).select("_k.*", "cid")


def _apart(name: str) -> Column:
    """The highest bit of each lane in which two packed longs differ."""
    low = sum(((1 << (SYMBOL_BITS - 1)) - 1) << (SYMBOL_BITS * k) for k in range(LANES))
    high = sum(1 << (SYMBOL_BITS * (k + 1) - 1) for k in range(LANES))
    x = F.col(f"l.{name}").bitwiseXOR(F.col(f"r.{name}"))
    return (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high))


def distance() -> Column:
    """Symbols in which the signatures of ``l`` and ``r`` differ, in JVM arithmetic."""
    total = F.lit(0)
    for name in SIG:
        total = total + F.bit_count(_apart(name))
    return total


def alike_in_size(share: int) -> Column:
    return 100 * F.least("l.n_shingles", "r.n_shingles") >= share * F.greatest("l.n_shingles", "r.n_shingles")


def may_overlap(share: int) -> Column:
    """Whether the bitmaps of ``l`` and ``r`` leave room for the intersection that the share asks for."""
    alone = lambda x, y: F.aggregate(F.zip_with(f"{x}.bits", f"{y}.bits", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda total, n: total + n)
    most = F.least(F.col("l.n_shingles") - alone("l", "r"), F.col("r.n_shingles") - alone("r", "l"))
    return (100 + share) * most >= share * (F.col("l.n_shingles") + F.col("r.n_shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, share: int, work: Scratch) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= share * union.

    ``a``'s set is read once for each salt and its partners stream past it.
    """
    pairs, sets = work.cut(pairs), sets.select("cid", "shingles")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS_PER_SALT).cast("int").alias("salts"))
    partners = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    partners = partners.join(sets.select(F.col("cid").alias("b"), "shingles"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "shingles")
    hubs = sets.withColumnRenamed("cid", "a").join(salts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"), "shingles")
    dealt = hubs.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def compare(batches):
        hub, own = None, None
        for batch in batches:
            left, right = [], []
            for a, role, b, shingles in zip(*(batch.column(c) for c in ("a", "role", "b", "shingles")), strict=True):
                other = np.frombuffer(shingles.as_buffer(), np.uint64)
                if role.as_py() == 0:
                    hub, own = a.as_py(), other.copy()
                    continue
                at = np.searchsorted(own, other)
                both = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                if 100 * both >= share * (len(own) + len(other) - both):
                    left.append(hub)
                    right.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return work.cut(dealt.mapInArrow(compare, "a long, b long"))


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(cid, component) for every end of an edge (a, b): the smallest number reachable.

    Large-star and small-star steps alternate until nothing changes; the number
    of rounds grows with the logarithm of a component's size.
    """
    edges = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v")
    state = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("_e")).select("_e.*")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select("v", F.col("m").alias("u")).where("u <> v")
        small_low = large.groupBy("v").agg(F.min("u").alias("m"))
        # each end points to its least neighbour, and its other neighbours point there too
        linked = large.join(small_low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("_e")).select("_e.*")
        edges = work.cut(linked.where("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("cid"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("cid"), F.col("u").alias("component")).distinct())


def hub_pairs(members: DataFrame, profiles: DataFrame, share: int, errors: int) -> DataFrame:
    """(a, b): each bucket's members with its two hubs, where within the distance and the bitmaps' bound."""
    stars = members.select("cid", F.explode(F.array(F.struct(F.col("lo").alias("hub"), F.lit(False).alias("high")), F.struct(F.col("hi").alias("hub"), F.lit(True).alias("high")))).alias("_h"), "lo")
    stars = stars.where("_h.hub <> cid and not (_h.high and cid = lo)").select(F.col("_h.hub").alias("a"), F.col("cid").alias("b")).distinct()
    close = stars.join(profiles.withColumnRenamed("cid", "a").alias("l"), "a").join(profiles.withColumnRenamed("cid", "b").alias("r"), "b")
    return close.where(alike_in_size(share) & (distance() <= max_distance(errors)) & may_overlap(share)).select("a", "b")


def symbols_of(packed: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) symbols of (rows, CHUNKS) longs."""
    lanes = np.arange(LANES, dtype=np.uint64) * _U(SYMBOL_BITS)
    return ((packed.view(np.uint64)[:, :, None] >> lanes) & _U((1 << SYMBOL_BITS) - 1)).astype(np.uint16).reshape(len(packed), -1)


def pairs_within(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None, share: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs within the distance and the bitmaps' bound, of other components, which this bucket is the first to hold.

    Without ``right`` these are pairs of ``left``, each once.
    """
    other = left if right is None else right
    apart = np.zeros((len(left["n"]), len(other["n"])), np.uint8)
    for mine, theirs in zip(left["symbols"].T, other["symbols"].T, strict=True):
        apart += mine[:, None] != theirs[None, :]
    small, large = np.minimum.outer(left["n"], other["n"]), np.maximum.outer(left["n"], other["n"])
    use = (apart <= max_distance(errors)) & (left["component"][:, None] != other["component"][None, :]) & (100 * small >= share * large)
    i, j = np.nonzero(np.triu(use, 1) if right is None else use)
    same = (left["symbols"][i] == other["symbols"][j]).reshape(len(i), CHUNKS, LANES).sum(axis=2, dtype=np.int64)
    first = np.argmax(same >= LANES - errors, axis=1)
    turn = (first == left["chunk"]) & ((left["choice"] == 0) | (same[np.arange(len(i)), first] < LANES))
    i, j = i[turn], j[turn]
    x, y = left["bits"][i], other["bits"][j]
    most = np.minimum(left["n"][i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), other["n"][j] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    fits = (100 + share) * most >= share * (left["n"][i] + other["n"][j])
    return i[fits], j[fits]


def open_pairs(members: DataFrame, found: DataFrame, profiles: DataFrame, share: int, errors: int) -> DataFrame:
    """(a, b): pairs of different components in one bucket, where within the distance and the bitmaps' bound.

    A bucket's members are dealt in blocks; each block meets itself and the blocks before it.
    """
    named = members.select("key", "chunk", "choice", "cid").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    still = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    still = named.join(still.select("key", F.ceil(F.col("n") / MEMBERS_PER_BLOCK).cast("int").alias("blocks")), "key").join(profiles, "cid")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    places = F.transform(F.sequence(F.lit(0), own), lambda block: F.struct(block.alias("block"), (block < own).cast("int").alias("role")))
    dealt = still.select("key", "chunk", "choice", "cid", "component", F.col("n_shingles").alias("n"), "bits", *SIG, F.explode(places).alias("_p")).select("*", "_p.*").drop("_p")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "role")

    def compare(batches):
        at, held = None, []  # the (key, block) at hand; its own rows in parts, once whole in one part
        whole = False

        def made(left, right):
            i, j = pairs_within(left, right, share, errors)
            return pa.RecordBatch.from_arrays([pa.array(left["cid"][i]), pa.array((left if right is None else right)["cid"][j])], names=["a", "b"])

        def closed():
            held[:] = [{c: np.concatenate([part[c] for part in held]) if np.ndim(held[0][c]) else held[0][c] for c in held[0]}]
            return made(held[0], None)

        for batch in batches:
            got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "chunk", "choice", "cid", "component", "n", "block", "role")}
            symbols = symbols_of(np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in SIG]))
            bits = batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(symbols), -1)
            edges = np.nonzero((np.diff(got["key"]) != 0) | (np.diff(got["block"]) != 0) | (np.diff(got["role"]) != 0))[0] + 1
            for lo, hi in zip([0, *edges], [*edges, len(symbols)], strict=True):
                if lo == hi:
                    continue
                rows = {c: got[c][lo:hi] for c in ("cid", "component", "n")} | {"symbols": symbols[lo:hi], "bits": bits[lo:hi], "chunk": got["chunk"][lo], "choice": got["choice"][lo]}
                if at != (got["key"][lo], got["block"][lo]):
                    if held and not whole:
                        yield closed()
                    at, held, whole = (got["key"][lo], got["block"][lo]), [], False
                if got["role"][lo] == 0:
                    held.append(rows)
                    continue
                if held and not whole:
                    yield closed()
                    whole = True
                if held:
                    yield made(held[0], rows)
        if held and not whole:
            yield closed()

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and text_hash and group_id for every row of ``documents``.

    ``group_id`` numbers the groups of linked texts (null for texts without
    words); it tells groups apart that share an id with different texts.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    errors = chunk_errors(share)
    with Scratch(spark) as work:
        sketched = work.cut(shingle_table(documents, id_col, text_col))
        by_set = sketched.where("n_shingles > 0").groupBy("f0", "f1", "n_shingles")
        one = by_set.agg(F.min("doc_id").alias("id"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"), *(F.min(s).alias(s) for s in SIG))
        classes = work.cut(one.withColumn("cid", F.monotonically_increasing_id()))
        signed = classes.select("cid", "n_shingles", *SIG)
        keys = signature_keys(signed, errors)
        buckets = keys.groupBy("key").agg(F.min("cid").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
        members = work.cut(keys.join(buckets, "key"))
        meets = members.groupBy("cid").agg(F.sum("n").alias("meets"))
        hubs = members.join(meets, "cid").groupBy("key").agg(F.max_by("cid", "meets").alias("hi"))
        members = work.cut(members.drop("n").join(hubs, "key"))

        texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
        wanted = classes.select("cid", F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).join(members.select("cid").distinct(), "cid", "left_semi")
        texts = texts.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")))
        sets = work.cut(set_table(texts.select("cid", "text").dropDuplicates(["cid"])))

        profiles = work.cut(signed.join(sets.select("cid", "bits"), "cid"))
        close = work.cut(hub_pairs(members, profiles, share, errors))
        links = confirmed(close, sets, share, work)
        found = components(links, work)
        rest = open_pairs(members, found, profiles, share, errors)
        tried = close.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_p")).select("_p.*")
        more = confirmed(rest.join(tried, ["a", "b"], "left_anti"), sets, share, work)
        if not more.isEmpty():
            found = components(links.unionByName(more), work)

        grouped = classes.select("f0", "f1", "n_shingles", "id", "cid").join(found, "cid", "left").withColumn("group_id", F.coalesce("component", "cid"))
        names = grouped.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("least"))
        grouped = grouped.join(names, "component", "left").select("f0", "f1", "n_shingles", "group_id", F.coalesce("least", "id").alias("component_id"))
        out = sketched.select("doc_id", "text_hash", "n_shingles", "f0", "f1").join(grouped, ["f0", "f1", "n_shingles"], "left")
        return cut(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "group_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
