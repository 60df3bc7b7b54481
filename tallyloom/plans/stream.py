"""Streaming queries over events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.sources.retail import table
from tallyloom.streaming import demand as Z


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def streaming_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.run_to_table(Z.weekly_totals(Z.events_stream(spark, f"{sf_dir}/events.parquet")), "weekly", "complete")


@query(
    """SELECT user_id, epoch_us(min(ts)) AS session_start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM (
        SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Z.sessions(rows).select("user_id", F.unix_micros("session_start").alias("session_start"), "n", "value")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.8::DOUBLE * a + 0.2::DOUBLE * x), 6) AS level FROM events GROUP BY 1")
def streaming_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = Z.run_to_table(Z.smoothed_state(Z.first_seen(Z.events_stream(spark, f"{sf_dir}/events.parquet"))), "state", "update")
    return updates.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("level", "n"), 6).alias("level"))
