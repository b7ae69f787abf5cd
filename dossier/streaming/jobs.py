"""Incremental audit, duplicate uploads and metrics over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_packages(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def incremental_audit(stream: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs the batch checks over each micro-batch and writes its findings to ``batch=<id>``; a batch that is run again
    after a failure replaces what it wrote. Stops when all files that are there have been read."""

    def one(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_uploads(stream: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """Uploads without those whose key came before inside the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def metrics(events: DataFrame, at: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls, errors and mean value by tumbling window; rows later than the watermark are dropped in a stream."""
    seen = events.withWatermark(at, late) if events.isStreaming else events
    sums = seen.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n_calls"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value"))
    return sums.select(F.col("w.start").alias("start"), "n_calls", "n_errors", "value")


def to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
