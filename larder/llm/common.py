"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where the setting
    is absent, a local folder is used if the master is local, as in tests;
    anything else is an error, as executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/larder-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Cut tables of one computation; they are deleted when its ``with`` block ends.

    What leaves the block must have been cut by :func:`cut` itself, or not
    depend on these tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.clear()

    def cut(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            place = hadoop(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``max_rows`` rows.

    A larger table is returned as it is, and the join shuffles both sides.
    Use it on narrow tables that have been cut, as it counts them.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for whole texts: at most 1000 rows and 8 MB.

    Spark's default of 10,000 rows makes batches of 30 MB and more of ordinary
    documents, held by the JVM and by each Python worker at once.  Spark reads
    the setting when a plan runs, so it has to outlive the call that makes one.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")


def text_runs(texts: pa.Array, chars: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, stop, texts) for runs of about so many characters; a longer text is a run of its own."""
    start = 0
    while start < len(texts):
        run, size = [], 0
        while start + len(run) < len(texts) and size < chars:
            run.append(texts[start + len(run)].as_py())
            size += len(run[-1] or "")
        yield start, start + len(run), run
        start += len(run)


_U = np.uint64
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, _U(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def run_hasher(units: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from (starts, stops) to 64-bit hashes of runs of ``units`` (bytes or code points): polynomial, then mixed."""
    n = len(units)
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + _U(1)) * power[:n], out=sums[1:])

    def hashes(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        length = (stops - starts).astype(np.uint64)
        return mixed((sums[stops] - sums[starts]) * inverse[starts] + mixed(length + _U(0x9E3779B97F4A7C15)))

    return hashes


def run_hashes(units: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return run_hasher(units)(starts, stops)


def runs_of(texts: list[str | None], member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lower-cased code points that ``member`` (by code point) holds: the points of all texts, starts, stops, and runs of each text."""
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    first = np.cumsum([0] + [len(p) + 1 for p in points])
    units = np.zeros(first[-1], np.uint32)  # texts end with a zero, which no run holds
    for p, at in zip(points, first, strict=False):
        units[at : at + len(p)] = p
    edge = np.diff(np.concatenate(([False], member[units], [False])).astype(np.int8))
    starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return units, starts, stops, np.diff(np.searchsorted(starts, first))
