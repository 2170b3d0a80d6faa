"""Event-time operators that give the same rows on a stream, once its watermark has passed, as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; one that is there stays, with its watermark."""
    return events if dict(events.dtypes)[time] == "timestamp" else events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """start, key, n for each window of `width`. On a stream give `late`: state older than that is dropped."""
    rows = _timed(events, time)
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """A stream's rows without repeats of the keys within `late`: the append log's answer to rows already written."""
    return _timed(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
