"""Streams run to their end over files; what they leave equals the batch query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.queries import query
from polyloom.queries.timeseries import events
from polyloom.streaming import continuous as C


def folder(spark: SparkSession) -> str:
    """Below the cluster's shared checkpoint folder; a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        import uuid

        return f"{base}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="polyloom-stream-")


@query(
    "t1_continuous_aggregate",
    "SELECT (epoch_us(ts) // 1000) // 86400000 * 86400000 AS bucket, event_type, count(*) AS count_all, round(sum(value), 4) AS sum_value, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value, last(value ORDER BY (epoch_us(ts) // 1000), value) AS last_value FROM events GROUP BY ALL",
)
def continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches arrive out of time order (by a hash of the id), so most rows of later batches are late; none is lost."""
    at = folder(spark)
    e = events(spark, sf_dir).withColumn("mixed", F.abs(F.hash("event_id")))
    agg = C.ContinuousAggregate(f"{at}/agg", "ms", "1d", ["event_type"], [C.Measure("count"), *[C.Measure(f, "value") for f in ("sum", "min", "max", "avg", "last")]])
    agg.start(C.replay(spark, e, at, 3, "mixed"), f"{at}/checkpoint").awaitTermination()
    return agg.read(spark).withColumn("sum_value", F.round("sum_value", 4)).withColumn("avg_value", F.round("avg_value", 6))


@query("t2_sketch_measures")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    agg = C.ContinuousAggregate(f"{at}/agg", "ms", "1d", ["event_type"], [C.Measure("count_distinct", "user_id"), C.Measure("percentile", "value", 0.9)])
    agg.start(C.replay(spark, events(spark, sf_dir), at), f"{at}/checkpoint").awaitTermination()
    return agg.read(spark)


@query("t1_tumbling", "SELECT epoch_us(ts) // 21600000000 * 21600000 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    e = events(spark, sf_dir).withColumn("at", F.timestamp_millis("ms"))
    s = C.tumbling(C.replay(spark, e, at, 3, "ms"), "at", "6 hours", ["event_type"], [F.count("*").alias("n")])
    # each batch's complete table replaces the one before it; nothing is gathered in the driver
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/tumbling")
    s.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/tumbling").select(F.unix_millis("window.start").alias("bucket"), "event_type", "n")


@query("t9_changes", "SELECT event_id AS lsn, event_type AS collection FROM events WHERE event_type = 'purchase' AND (epoch_us(ts) // 1000) >= 1704585600000")
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).select(F.col("event_id").alias("lsn"), F.col("event_type").alias("collection"), F.col("ms").alias("ts_ms"))
    return C.changes(c, "purchase", ["lsn", "collection"], 1_704_585_600_000)


@query(
    "t13_geofence",
    "WITH e AS (SELECT event_id, user_id, value > 50 AS i, coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id), FALSE) AS w FROM events) SELECT user_id, event_id, CASE WHEN i THEN 'enter' ELSE 'exit' END AS event FROM e WHERE i <> w",
)
def geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.geofence(events(spark, sf_dir), "user_id", "event_id", F.col("value") > 50)


@query("t14_materialized_view", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.refresh_view(events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")), f"{folder(spark)}/view")


@query("t7_two_tiers", "SELECT (epoch_us(ts) // 1000) // 86400000 * 86400000 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    hourly = C.ContinuousAggregate(f"{at}/agg", "ms", "1h", [], [C.Measure("count")])
    hourly.start(C.replay(spark, events(spark, sf_dir), at), f"{at}/checkpoint").awaitTermination()
    return hourly.read(spark).groupBy((F.col("bucket") - F.col("bucket") % 86_400_000).alias("bucket")).agg(F.sum("count_all").alias("n"))


@query("t11_session_windows", "WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS sessions FROM e GROUP BY user_id")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("at", F.timestamp_micros(F.col("ms") * 1000))
    s = e.groupBy("user_id", F.session_window("at", "1 hour")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))
