"""Streams of log rows: resumable append, replacement per repository, retries, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.readers import exists


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "repo") -> StreamingQuery:
    """Append each batch's rows whose key the log doesn't hold yet.

    A batch that is replayed after a failure finds its rows in the log and adds
    nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        if exists(batch.sparkSession, path):
            fresh = fresh.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_per_repository(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch by ``repo_key``, replacing what earlier batches wrote for the same repositories."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_key").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_retry(stream: DataFrame, time: str = "ts", key: str = "repo", wait: str = "1 day") -> DataFrame:
    """Failed rows of a stream, each key once within the watermark."""
    return stream.filter("status = 'clone_failed'").withWatermark(time, wait).dropDuplicatesWithinWatermark([key])


def status_counts(rows: DataFrame, time: Column, window: str = "1 day", wait: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``window_start, status, n, total`` of tumbling or sliding event-time windows; for batches and streams alike."""
    timed = rows.withColumn("__time", time.cast("timestamp"))
    timed = timed.withWatermark("__time", wait)
    at = F.window("__time", window, slide) if slide else F.window("__time", window)
    out = timed.groupBy(at.alias("w"), "status").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "status", "n", "total")


def sessions(rows: DataFrame, time: Column, key: str, gap: str = "30 minutes", wait: str = "1 hour") -> DataFrame:
    """``key, session_start, session_end, n`` of bursts of rows with gaps of less than ``gap``."""
    timed = rows.withColumn("__time", time.cast("timestamp")).withWatermark("__time", wait)
    out = timed.groupBy(F.session_window("__time", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class Progress(StreamingQueryListener):
    """Calls ``report(rows so far, rows a second)`` after each batch."""

    def __init__(self, report: Callable[[int, float], None]):
        self._report, self._rows = report, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self._rows += event.progress.numInputRows
        self._report(self._rows, event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
