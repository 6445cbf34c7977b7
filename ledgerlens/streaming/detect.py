"""Incremental ingest and detection.

Event-time windows with watermarks where a result closes with time, and
foreachBatch with an anti join on alert keys where detection must be idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Rows of parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_counts(calls: DataFrame, late: str = "2 days") -> DataFrame:
    """Calls and talk time of each unordered pair in each UTC day, in tumbling windows."""
    pair = [F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")]
    windows = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), *pair).agg(F.count("*").alias("calls"), F.sum("duration_sec").alias("talk_sec"))
    return windows.select("a", "b", F.to_date("window.start").alias("day"), "calls", "talk_sec")


def trailing_counts(calls: DataFrame, days: int = 7, late: str = "2 days") -> DataFrame:
    """Calls of each caller in every window of so many days, sliding by a day."""
    windows = calls.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day"), "caller").agg(F.count("*").alias("calls"))
    return windows.select("caller", F.to_date("window.start").alias("first_day"), "calls")


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a caller's calls without a pause longer than gap."""
    windows = calls.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "caller").agg(F.count("*").alias("calls"))
    return windows.select("caller", F.col("session_window.start").alias("begun"), F.col("session_window.end").alias("ended"), "calls")


def append_new(alerts: DataFrame, path: str) -> int:
    """Append the alerts whose key the table at path does not hold; how many there were."""
    spark = alerts.sparkSession
    try:
        stored = spark.read.parquet(path).select("key")
    except Exception as error:  # the table does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], "key string")
    fresh = alerts.dropDuplicates(["key"]).join(stored, "key", "left_anti").persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def detect_on_arrival(stream: DataFrame, store: str, alerts_path: str, checkpoint: str, detectors: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> StreamingQuery:
    """Keep arriving rows in store and run the detectors over all of it after each batch.

    Each detector gives rows with a key; keys that are stored already raise
    nothing, so a batch that is run again after a failure changes nothing.  A
    detector that fails does not stop the others; its error is raised at the end.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        known = rows.sparkSession.read.schema(rows.schema).parquet(*[f"{store}/batch={i}" for i in range(number + 1)])
        errors = []
        for name, detector in detectors:
            try:
                append_new(detector(known), alerts_path)
            except Exception as error:
                errors.append((name, error))
        if errors:
            raise RuntimeError(f"detector {errors[0][0]} failed") from errors[0][1]

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
