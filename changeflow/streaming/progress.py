"""Throughput of a live run (A10 streaming): progress rows of streaming
queries, and statistics over them.

``ProgressLog`` is a ``StreamingQueryListener`` that keeps one row per
finished micro-batch.  Rows are buffered and written by ``flush`` (at the
latest when the query ends), partitioned by query and batch, so a row that is
written again replaces itself.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from changeflow.streaming.stream import _read_if_any

PROGRESS = ("query_id string, run_id string, query_name string, batch_id long, batch_time timestamp_ntz, input_rows long, "
            "input_rows_per_second double, processed_rows_per_second double, duration_ms long")


class ProgressLog(StreamingQueryListener):
    """Add it with ``spark.streams.addListener``; batches without rows are
    kept too, with 0."""

    def __init__(self, spark: SparkSession, path: str, buffer: int = 100):
        self.spark, self.path, self.buffer = spark, path, buffer
        self.rows: dict[tuple, tuple] = {}
        self.ended: set[str] = set()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.id), str(p.runId), p.name, int(p.batchId), p.timestamp, int(p.numInputRows),
               float(p.inputRowsPerSecond or 0), float(p.processedRowsPerSecond or 0), int(p.batchDuration))
        with self.lock:
            self.rows[row[0], row[3]] = row
            full = len(self.rows) >= self.buffer
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self.ended.add(str(event.runId))

    def wait(self, run_id, seconds: float = 30) -> None:
        """Until the end of a run has been seen (events arrive a moment after
        the query has ended) and its rows are written."""
        until = time.monotonic() + seconds
        while str(run_id) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        self.flush()

    def flush(self) -> None:
        """Write what is buffered; a few rows, so one file a batch."""
        with self.lock:
            rows, self.rows = list(self.rows.values()), {}
        if not rows:
            return
        df = self.spark.createDataFrame(rows, PROGRESS.replace("batch_time timestamp_ntz", "batch_time string"))
        # ISO time in UTC: the zone letter goes, the fields stay
        df = df.withColumn("batch_time", F.to_timestamp_ntz(F.regexp_replace("batch_time", "Z$", "")))
        (df.withColumns({"q": F.col("query_id"), "b": F.col("batch_id")}).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("q", "b").parquet(self.path))


def progress_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that were written, None before any was."""
    df = _read_if_any(spark, path)
    return None if df is None else df.drop("q", "b")


def stream_throughput(progress: DataFrame) -> DataFrame:
    """A10 of a run, one row per query: batches, rows, seconds from the start
    of its first batch to the end of its last, rows per second over that time
    and over the time spent in batches, and the last batch's time."""
    end = F.unix_micros(F.col("batch_time").cast("timestamp")) + F.col("duration_ms") * 1000
    agg = progress.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("events_processed"),
        ((F.max(end) - F.min(F.unix_micros(F.col("batch_time").cast("timestamp")))) / 1e6).alias("run_seconds"),
        (F.sum("duration_ms") / 1e3).alias("busy_seconds"), F.max("batch_time").alias("last_batch_time"))
    rate = lambda s: F.when(F.col(s) > 0, F.col("events_processed") / F.col(s)).otherwise(F.lit(0.0))     # noqa: E731
    return agg.withColumns({"events_per_second": rate("run_seconds"), "events_per_busy_second": rate("busy_seconds")})
