"""Windows over events, as batches; tests run the same functions on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..storage import shared_folder
from ..streaming import jobs, smoothing


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS begin, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def k5_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "1 day")
    return rows.select("event_type", F.col("begin").cast("timestamp_ntz").alias("begin"), "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM y GROUP BY user_id, s""")
def k6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("begin", "stop")], "n")


@query("SELECT event_id, value FROM events WHERE event_id % 50 = 0")
def k4_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th step is the feature: a periodic trigger."""
    return jobs.every(table(spark, sf_dir, "events"), "event_id", 50).select("event_id", "value")


@query("""WITH w AS (SELECT event_type, event_id, ts, value, median(value) OVER w AS median, avg(value) OVER w AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 19 PRECEDING))
SELECT event_type, event_id, round(value, 6) AS value, round(median, 6) AS median, round(mean, 6) AS mean FROM w WHERE date_trunc('milliseconds', ts) < (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def k3_smoothed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of metrics, read to its end: the last values are held, as the watermark has not passed them."""
    smoothing.use_state_store(spark)
    folder = f"{shared_folder(spark)}/smoothed-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    stream = smoothing.smooth(rows, "event_type", "ts", "event_id", "value", 20, "0 seconds", idle="365 days")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.select("event_type", F.col("step").alias("event_id"), *[F.round(c, 6).alias(c) for c in ("value", "median", "mean")])
