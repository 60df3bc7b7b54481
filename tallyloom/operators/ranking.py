"""Ranks and running totals over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize


def running_totals(df: DataFrame, order: list[str | Column], value: str) -> DataFrame:
    """df with rank (from 1 on) and running (the sum of value up to the row) in the given order, and total. Rows are dealt out by ranges
    of the order and written; a row per range carries what stands before it, so every window stays within a range. The order must
    be total."""
    placed = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    ranges = placed.groupBy("__range").agg(F.count("*").alias("__n"), F.sum(value).alias("__v"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    told = ranges.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rank"), F.coalesce(F.sum("__v").over(before), F.lit(0.0)).alias("__sum"), F.sum("__v").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("__range").orderBy(*order)
    rows = placed.join(F.broadcast(told), "__range")
    return rows.select(*df.columns, (F.row_number().over(own) + F.col("__rank")).alias("rank"), (F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__sum")).alias("running"), "total")
