"""Feedback as a stream: counted by project and window, late events dropped behind a watermark, and gated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENOUGH = 6


def windowed(feedback: DataFrame, at: str = "ts", project: str = "user_id", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(project, window_start, n, may_start); works on a stream and on a table alike.

    Events without time or project count for nothing; on a stream, events older than the watermark are late.
    """
    known = feedback.where(F.col(at).isNotNull() & F.col(project).isNotNull()).select(F.col(at).cast("timestamp").alias(at), project)
    counted = known.withWatermark(at, late).groupBy(F.window(at, width), F.col(project).alias("project")).agg(F.count("*").alias("n"))
    return counted.select("project", F.col("window.start").alias("window_start"), "n", (F.col("n") >= ENOUGH).alias("may_start"))


def start(stream: DataFrame, sink, checkpoint: str):
    """Append finished windows through ``sink`` (a foreachBatch function), resumable from ``checkpoint``."""
    return windowed(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
