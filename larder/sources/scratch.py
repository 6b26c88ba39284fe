"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``).

    A local folder is used only where the setting is absent and the master is local, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/larder-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: ends the lineage and the plan of what is used several times."""
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over as many tasks as the session has partitions, however small their files: work on a row is more than its bytes tell.

    Dealt in turn, as a repartition by the keys of an aggregate below it would be left out.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
