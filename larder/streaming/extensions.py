"""Streaming forms of the batch operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def resolve_stream(lines: DataFrame, resolve, path: str, checkpoint: str):
    """Each micro-batch of lines resolved by ``resolve(batch)`` and appended to ``path``."""
    return lines.writeStream.foreachBatch(lambda batch, _: resolve(batch).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
