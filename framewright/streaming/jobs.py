"""Structured Streaming: resumable ingestion, metric streams, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], files_per_batch: int = 64) -> StreamingQuery:
    """Processes files of source that no earlier run has seen, appends the result to target, and stops.

    The checkpoint is the ledger: after a failure the batch that was under way is done again, and written once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return process(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batches(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 64) -> StreamingQuery:
    """The same with a function for each batch, which may write several tables; it sees a batch again after a failure."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; ts without one is read in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, ts: str, keys: list[str], value: str, length: str, late: str | None = None) -> DataFrame:
    """(keys, begin, n, total) of windows of a length; rows later than late are dropped in streams. Works on both."""
    rows = event_time(df, ts)
    rows = rows.withWatermark(ts, late) if late else rows
    out = rows.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("begin"), "n", "total")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """(keys, begin, stop, n) of runs of events less than gap apart."""
    rows = event_time(df, ts)
    rows = rows.withWatermark(ts, late) if late else rows
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("begin"), F.col("w.end").alias("stop"), "n")


def every(df: DataFrame, step: str, k: int) -> DataFrame:
    return df.where(F.pmod(F.col(step), F.lit(k)) == 0)
