"""Structured Streaming over change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_touches(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Touches (file, mtime) of a stream, each once within the watermark, late ones beyond it dropped."""
    return events.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(["file", "mtime"])


def touches_per_window(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, file, n) of a stream or a table of touches."""
    return events.withWatermark("mtime", delay).groupBy(F.window("mtime", window), "file").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "file", "n")


def refresh_on_change(events: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``refresh(changed_files, batch_id)`` for each micro-batch. A batch may be repeated after a failure, so ``refresh`` must be idempotent, as partition overwrites are."""
    return file_touches(events).writeStream.foreachBatch(lambda df, n: refresh(df.select("file").distinct(), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
