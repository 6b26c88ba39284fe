"""Streams equal the batch operators for any split into micro-batches, out of order and after a restart."""

import os

import pytest
from pyspark.sql import Window, functions as F

from larder.operators import feedback, history
from larder.plans import testdata as T
from larder.streaming import stateful

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def run(make, source, path, limit):
    """A function that runs the stream over the files so far, ``limit`` a batch, going on from its checkpoint."""
    spark, schema = source.sparkSession, source.schema

    def once(files):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", limit).json(files)
        q = make(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    return once


def events(spark):
    items = T.frame(spark, SF, T.SCAN_ITEMS)
    return items.select(F.col("event_type").alias("key"), (F.col("user_id") % 7).alias("user"), "seq", (F.col("seq") % 3 != 0).alias("accepted"), F.col("scan_date").cast("timestamp").alias("ts"), "scan_date")


@pytest.mark.parametrize(("files", "limit"), [(1, 1), (5, 1), (6, 3)])
def test_preferences(spark, tmp_path, files, limit):
    stateful.use_state_store(spark)
    source = events(spark)
    source.cache()
    want = {(r.user, r.key): (round(r.multiplier, 9), r.n_events) for r in feedback.preference_fold(source, ["user", "key"], 0.3).collect()}
    schema_source = source.select("user", "key", "seq", "accepted", "ts")
    path = str(tmp_path)
    once = run(lambda s: stateful.preference_stream(s, ["user", "key"], 0.3, late="4000 days"), schema_source, path, limit)
    half = files // 2
    for part in (range(half), range(half, files)):  # the second run goes on from the checkpoint
        for k in part:
            schema_source.where(F.pmod(F.xxhash64("seq"), F.lit(files)) == k).coalesce(1).write.mode("append").json(f"{path}/all")
        if len(part):
            once(f"{path}/all")
    out = spark.read.parquet(f"{path}/out")
    last = out.withColumn("k", F.row_number().over(Window.partitionBy("user", "key").orderBy(F.desc("batch")))).where("k = 1").collect()
    assert {(r.user, r.key): (round(r.multiplier, 9), r.n_events) for r in last} == want and all(r.n_late == 0 for r in last)


def test_late_preferences_are_counted(spark, tmp_path):
    stateful.use_state_store(spark)
    rows = spark.sql("SELECT 1 AS user, 'a' AS key, CAST(id AS BIGINT) AS seq, id % 2 = 0 AS accepted, timestamp_millis(86400000 * id) AS ts FROM range(40)")
    path = str(tmp_path)
    once = run(lambda s: stateful.preference_stream(s, ["user", "key"], 0.3, late="2 days"), rows, path, 1)
    for low, high in ((10, 20), (20, 30), (30, 40), (0, 10)):  # the last file comes when its events' places are settled
        rows.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").json(f"{path}/all")
        once(f"{path}/all")
    out = spark.read.parquet(f"{path}/out").orderBy(F.desc("batch"), F.desc("n_events")).first()
    want = feedback.preference_fold(rows.where("seq >= 10"), ["user", "key"], 0.3).first()
    assert (round(out.multiplier, 9), out.n_events) == (round(want.multiplier, 9), 30)


def test_capped_log(spark, tmp_path):
    stateful.use_state_store(spark)
    log = events(spark).select(F.col("user").cast("long").alias("user"), "seq", F.concat("key", F.lit("-"), "seq").alias("entry"))
    path = str(tmp_path)
    once = run(lambda s: stateful.log_stream(s, 5, "user"), log, path, 1)
    for k in range(4):
        log.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == k).coalesce(1).write.mode("append").json(f"{path}/all")
        if k % 2:
            once(f"{path}/all")
    out = spark.read.parquet(f"{path}/out")
    last = out.withColumn("m", F.max("version").over(Window.partitionBy("user"))).where("version = m").select("user", "seq", "entry")
    want = history.last_entries(log, 5, F.col("user"), "seq").select("user", "seq", "entry")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_weeks_with_corrections(spark, tmp_path):
    items = T.frame(spark, SF, T.SCAN_ITEMS)
    scans = items.groupBy("scan_id").agg(F.min("scan_date").alias("date"), F.max("is_shopping_list").alias("is_shopping_list"), F.max((F.col("confidence") * 100).cast("int")).alias("average_score"))
    scans = scans.select("scan_id", "date", "is_shopping_list", F.when(F.xxhash64("scan_id") % 9 != 0, F.col("average_score")).alias("average_score")).cache()
    path = str(tmp_path)
    days = scans.agg(F.min("date"), F.max("date")).first()
    cuts = [days[0] + (days[1] - days[0]) * k / 4 for k in range(5)]
    parts = [scans.where((F.col("date") >= F.lit(cuts[k])) & ((F.col("date") < F.lit(cuts[k + 1])) | F.lit(k == 3))) for k in (0, 2, 3, 1)]  # the second quarter comes last
    for part in parts:
        part.coalesce(1).write.mode("append").json(f"{path}/in")
        stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).json(f"{path}/in")
        stateful.weekly_stream(stream, f"{path}/weeks", f"{path}/check", late_days=7).awaitTermination()
    plain = lambda frame: sorted(map(str, (tuple(r) for r in frame.select("week_start", "week_end", "n_scans", "average_score").collect())))
    assert plain(stateful.weeks_of(spark, f"{path}/weeks")) == plain(history.weekly_groups(scans))
    late = spark.read.parquet(f"{path}/weeks/corrections").count()
    assert late > 0 and stateful.weeks_of(spark, f"{path}/weeks", corrected=False).agg(F.sum("n_scans")).first()[0] + late == scans.where("not is_shopping_list").count()
