"""Structured Streaming over events: windows with watermarks, sessions, and smoothing state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.session import fresh_path, ship


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    # the file source takes a folder or a pattern; the pattern matches the table alone
    return spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]").withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and value by type and week from Monday on; events later than `late` go. Spark's windows count from a Thursday, so they
    are shifted by four days."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "7 days", "4 days"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.to_date("window.start").alias("week"), "event_type", "n", F.round("value", 2).alias("value"))


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without repeated ids, as far as the watermark remembers them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events at most gap apart."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "value")


def smoothed_state(events: DataFrame, alpha: float = 0.2) -> DataFrame:
    """user_id, n and level: an exponentially smoothed value by user, carried from batch to batch. Rows of a batch count in order of
    time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, level = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for value in rows["value"]:
            level = float(value) if not n else alpha * float(value) + (1 - alpha) * level
            n += 1
        state.update((n, level))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "level": [level]})

    ship(events.sparkSession)
    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, level double", "n long, level double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there, each batch as files in the shared folder; the last batch of each is the result's state.
    complete: the last batch alone; update: rows of all batches with their batch number."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/b={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/data").drop("b")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch") if mode == "complete" else out
