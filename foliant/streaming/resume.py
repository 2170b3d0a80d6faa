"""Extraction that goes on where it stopped: a checkpointed stream whose rows are written once, its counters, and restarts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import readers


def extract(rows: DataFrame, keep: dict, key: str) -> tuple[DataFrame, dict]:
    """Rows that pass all conditions of `keep` (name: condition, in order), and counters for observe(): rows processed and left after each."""
    left, counts = F.lit(True), {"processed": F.count(F.lit(1))}
    for name, holds in keep.items():
        left = left & F.coalesce(holds, F.lit(False))
        counts[name] = F.count_if(left)
    return rows.filter(left & F.col(key).isNotNull()), counts


def append_once(source: DataFrame, path: str, checkpoint: str, key: str, counters: dict | None = None, name: str = "extraction") -> StreamingQuery:
    """Writes a stream's rows to a Parquet table, of each key one, whatever is in the table already. A micro-batch that was cut off is done again; its rows that
    were written are left out. State is the table itself, not the stream's memory."""
    counted = source.observe("progress", *(v.alias(k) for k, v in counters.items())) if counters else source

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if readers.exists(spark, f"{path.rstrip('/')}/part-*"):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return counted.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def progress(query: StreamingQuery, total: int | None = None) -> dict | None:
    """Rows so far, rows a second of the last batch, and with a total the minutes left (10 % less and more); None before the first batch."""
    last = query.lastProgress
    if not last:
        return None
    done = sum(p["numInputRows"] for p in query.recentProgress)
    rate = last.get("processedRowsPerSecond") or 0.0
    out = {"batch": last["batchId"], "rows": done, "rate": rate, "counters": {k: v.asDict() if hasattr(v, "asDict") else v for k, v in (last.get("observedMetrics") or {}).items()}}
    return out | (estimate(total - done, rate) if total is not None else {})


def estimate(rows: float, rate: float, margin: float = 0.1) -> dict:
    """Minutes for so many rows at a rate a second, with a margin either way; None at no rate."""
    minutes = rows / rate / 60 if rate > 0 else None
    return {"minutes": minutes, "minutes_low": None if minutes is None else minutes * (1 - margin), "minutes_high": None if minutes is None else minutes * (1 + margin)}


def monitor(query: StreamingQuery, tell: Callable[[dict], None], every: float = 5.0, total: int | None = None) -> None:
    """Calls tell(progress) until the stream ends; raises what it ended with."""
    while not query.awaitTermination(timeout=every):
        if now := progress(query, total):
            tell(now)
    if now := progress(query, total):
        tell(now)


def restarted(run: Callable[[int], object], most: int = 3, wait: float = 1.0, retry: tuple = (Exception,)) -> object:
    """run(attempt) again after a failure, `most` times in all; the last failure is raised. What it did must be safe to do again, as append_once() is."""
    for attempt in range(1, most + 1):
        try:
            return run(attempt)
        except retry:
            if attempt == most:
                raise
            time.sleep(wait)
    raise ValueError("most must be at least 1")


def in_chunks(spark: SparkSession, rows: DataFrame, key: str, path: str, chunks: int, make: Callable[[DataFrame], DataFrame]) -> int:
    """make() over `chunks` parts of the rows (by hash of their key), each written before the next begins; parts that are there are not made again. Returns how many were made."""
    made = 0
    for k in range(chunks):
        place = f"{path.rstrip('/')}/chunk={k}"
        if not readers.exists(spark, f"{place}/_SUCCESS"):
            make(rows.filter(F.pmod(F.xxhash64(key), F.lit(chunks)) == k)).write.mode("overwrite").parquet(place)
            made += 1
    return made
