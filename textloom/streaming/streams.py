"""Streams: operators that work on each document by itself run on a stream as they are; others run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def by_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write ``operator`` of each batch as Parquet under ``path``; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def busy_windows(requests: DataFrame, time: str = "ts", key: str = "event_type", length: str = "60 seconds", slide: str | None = None, least: int = 100, late: str = "10 minutes") -> DataFrame:
    """Windows in which a key had at least ``least`` requests: when a dictionary is worth keeping in memory. Works on
    streams, where rows later than ``late`` are given up, and on tables."""
    rows = requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if requests.isStreaming else requests
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counts = rows.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") >= least)
    return counts.select(F.col("w.start").alias("window_start"), key, "requests")
