"""Stateful streams: running preferences, capped logs and weeks with corrections.

Preferences and logs keep their state in Spark's state store (a RocksDB store,
see :func:`use_state_store`), one small state a key, and survive a restart from the
checkpoint.  Events may come in any order: what is not yet settled by the watermark
is kept and replayed in order of ``seq``.  Spark drops events behind the watermark
(``numRowsDroppedByWatermark`` of the query's progress); one that is not, but whose place
in its key's order is settled, is not applied, and counted in ``n_late``.

Weeks are kept as partial sums, one set of rows a micro-batch, written under the
batch's number: a batch that is run twice replaces its own rows.  Rows of weeks
that had closed when they came go to a correction table instead.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.functions.nutrition import half_up
from larder.operators.feedback import HIGH, LOW, RATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Selects the state store that arbitrary stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Preference(StatefulProcessor):
    """One key's multiplier: settled events in three numbers, later ones as they are."""

    def __init__(self, keys: list[str], step: float):
        self.keys, self.step = keys, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "multiplier double, n_events long, until long, n_late long")
        self.waiting = handle.getMapState("waiting", "seq long", "accepted boolean, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        multiplier, n, until, late = self.settled.get() if self.settled.exists() else (1.0, 0, -(2**63), 0)
        waiting = {k[0]: v for k, v in self.waiting.iterator()}
        for part in rows:
            for seq, accepted, at in zip(part["seq"], part["accepted"], part["at"], strict=True):
                if seq <= until:
                    late += 1
                else:
                    waiting[int(seq)] = (bool(accepted), int(at))
                    self.waiting.updateValue((int(seq),), (bool(accepted), int(at)))
        watermark = timerValues.getCurrentWatermarkInMs()
        open_, current = False, (multiplier, n)
        for seq, (accepted, at) in sorted(waiting.items()):
            current = current[0] + self.step * ((HIGH if accepted else LOW) - current[0]), current[1] + 1
            open_ = open_ or at >= watermark  # an event is settled with all before it, not before them
            if not open_:
                multiplier, n, until = *current, seq
                self.waiting.removeKey((seq,))
        self.settled.update((multiplier, n, until, late))
        yield pd.DataFrame([[*key, current[0], current[1], late]], columns=[*self.keys, "multiplier", "n_events", "n_late"])

    def close(self) -> None:
        pass


def preference_stream(events: DataFrame, keys: list[str], share: float, late: str = "7 days", ts_col: str = "ts") -> DataFrame:
    """keys, multiplier, n_events, n_late of every key that a micro-batch touches, as ``preference_fold`` gives them for all events so far.

    ``events`` has the keys, ``seq`` (distinct numbers, the order of events), ``accepted`` and the event time.
    An event is settled once the watermark has passed it and all events before it; the state of a key holds
    three numbers and the events of the time that ``late`` spans.
    """
    rows = events.withWatermark(ts_col, late).select(*keys, "seq", "accepted", F.unix_millis(ts_col).alias("at"), ts_col)
    schema = T.StructType([*(events.schema[k] for k in keys), *T.StructType.fromDDL("multiplier double, n_events long, n_late long")])
    return rows.groupBy(*keys).transformWithStateInPandas(_Preference(keys, RATE * share), schema, outputMode="Update", timeMode="EventTime")


class _LastEntries(StatefulProcessor):
    """The last entries of one key's log."""

    def __init__(self, key: str, n: int):
        self.key, self.n = key, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "seq long, entry string")
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(self.log.get())
        for part in rows:
            held |= {int(seq): entry for seq, entry in zip(part["seq"], part["entry"], strict=True)}
            held = dict(sorted(held.items())[-self.n :])
        kept = sorted(held.items())
        self.log.put(kept)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        yield pd.DataFrame([(*key, version, seq, entry) for seq, entry in kept], columns=[self.key, "version", "seq", "entry"])

    def close(self) -> None:
        pass


def log_stream(log: DataFrame, n: int, key: str) -> DataFrame:
    """key, version, seq, entry: the last ``n`` entries of each key that a micro-batch touches; the greatest version is the log.

    ``log`` has the key, ``seq`` (distinct numbers) and ``entry``.  State: at most ``n`` entries a key, however long its log.
    """
    schema = T.StructType([log.schema[key], *T.StructType.fromDDL("version long, seq long, entry string")])
    return log.select(key, "seq", "entry").groupBy(key).transformWithStateInPandas(_LastEntries(key, n), schema, outputMode="Update", timeMode="None")


def weekly_stream(scans: DataFrame, path: str, checkpoint: str, late_days: int = 14):
    """Starts a query that sums ``scans`` (scan_id, date, is_shopping_list, average_score) by Monday week below ``path``.

    A week closes ``late_days`` after its end, by the latest date of earlier batches; rows of
    closed weeks are appended to ``path``/corrections, others as sums to ``path``/sums.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = lambda name: f"{path}/{name}/batch={number}"
        rows = batch.where(~F.coalesce("is_shopping_list", F.lit(False))).withColumn("week_start", F.date_trunc("week", "date").cast("date"))
        earlier = spark.read.schema("latest date, batch long").parquet(f"{path}/dates").where(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None
        closed = F.coalesce(F.date_add("week_start", 6 + late_days) < F.lit(earlier).cast("date"), F.lit(False))
        rows = rows.persist()
        sums = rows.where(~closed).groupBy("week_start").agg(F.count(F.lit(1)).alias("n_scans"), F.count("average_score").alias("n_scores"), F.sum("average_score").alias("scores"))
        sums.write.mode("overwrite").parquet(place("sums"))
        rows.where(closed).select("scan_id", "date", "week_start", "average_score").write.mode("overwrite").parquet(place("corrections"))
        rows.agg(F.max("date").alias("latest")).write.mode("overwrite").parquet(place("dates"))
        rows.unpersist()

    return scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weeks_of(spark: SparkSession, path: str, corrected: bool = True) -> DataFrame:
    """week_start, week_end, n_scans, average_score from what :func:`weekly_stream` wrote, with or without corrections."""
    sums = spark.read.schema("week_start date, n_scans long, n_scores long, scores long").parquet(f"{path}/sums")
    if corrected:
        late = spark.read.schema("scan_id string, date date, week_start date, average_score int").parquet(f"{path}/corrections")
        score = F.col("average_score")
        sums = sums.drop("batch").unionByName(late.select("week_start", F.lit(1).cast("long").alias("n_scans"), score.isNotNull().cast("long").alias("n_scores"), score.cast("long").alias("scores")))
    weeks = sums.groupBy("week_start").agg(F.sum("n_scans").alias("n_scans"), F.sum("scores").alias("scores"), F.sum("n_scores").alias("n_scores"))
    score = half_up(F.col("scores") / F.nullif(F.col("n_scores"), F.lit(0))).cast("int")
    return weeks.select("week_start", F.date_add("week_start", 6).alias("week_end"), "n_scans", score.alias("average_score"))
