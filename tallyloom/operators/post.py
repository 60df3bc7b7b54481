"""Caps, gates, thresholds and weights around forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_cap(train: DataFrame, quantile: float = 0.95, multiplier: float = 1.5, lookback: int = 56) -> DataFrame:
    """sku, cap: of the last days' positive values, the larger of a quantile and a multiple of the mean, at most 1.5 times the largest;
    0 without positive values."""
    rn = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))
    pos = F.when(F.col("y") > 0, F.col("y"))
    recent = train.withColumn("__rn", rn).where(F.col("__rn") <= lookback)
    return recent.groupBy("sku").agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.greatest(F.percentile(pos, quantile), F.avg(pos) * multiplier), F.max(pos) * 1.5)), F.lit(0.0)).alias("cap"))


def clean(pred: Column, threshold: float, cap: Column | None = None) -> Column:
    """No negative, undefined or infinite values; at most cap; 0 below the threshold."""
    value = F.when(pred.isNull() | F.isnan(pred) | (F.abs(pred) == float("inf")), 0.0).otherwise(F.greatest(pred, F.lit(0.0)))
    value = value if cap is None else F.least(value, cap)
    return F.when(value < threshold, 0.0).otherwise(value)


def global_cap(train: DataFrame, q: float) -> DataFrame:
    """One row: the quantile of all positive values, infinite without any."""
    return train.agg(F.coalesce(F.percentile(F.when(F.col("y") > 0, F.col("y")), q), F.lit(float("inf"))).alias("cap"))


def count_target(y: Column, cap: Column, hard: float = 200.0) -> Column:
    """Non-negative whole numbers (halves to even), at most both caps."""
    return F.least(F.bround(F.greatest(y, F.lit(0.0))), cap, F.lit(hard))


def two_stage(p_sale: Column, size: Column, tau: float = 0.25, alpha: float = 0.9, cap: Column | None = None) -> Column:
    """Probability times size, 0 below the gate, scaled, at most cap."""
    value = F.greatest(F.lit(alpha) * F.when(p_sale < tau, 0.0).otherwise(p_sale * size), F.lit(0.0))
    return value if cap is None else F.least(value, cap)


def sku_tau(train: DataFrame, q: float = 0.05) -> DataFrame:
    """sku, tau (quantile of its positive values, else that of all), scale (lower for series that often sell) and their product."""
    pos = F.when(F.col("y") > 0, F.col("y"))
    whole = F.broadcast(train.agg(F.coalesce(F.percentile(pos, q), F.lit(0.0)).alias("all")))  # one row
    own = train.groupBy("sku").agg(F.percentile(pos, q).alias("tau"), F.avg((F.col("y") > 0).cast("double")).alias("rate"))
    scale = F.least(F.greatest(F.lit(0.60) - 0.40 * F.col("rate"), F.lit(0.15)), F.lit(0.60))
    return own.crossJoin(whole).select("sku", F.coalesce("tau", "all").alias("tau"), scale.alias("scale"), (F.coalesce("tau", "all") * scale).alias("threshold"))


def positive_weights(rows: DataFrame) -> DataFrame:
    """rows (of positive y) with weight: rising with the square root of y over the median, boosted in the tails, within 1 to 8."""
    one = F.broadcast(rows.agg(F.greatest(F.median("y"), F.lit(1.0)).alias("__m"), F.percentile("y", 0.90).alias("__a"), F.percentile("y", 0.98).alias("__b")))
    base = F.sqrt(F.col("y") / F.col("__m") + 1.0)
    boost = F.when(F.col("y") >= F.col("__a"), 1.5).otherwise(1.0) * F.when(F.col("y") >= F.col("__b"), 2.0).otherwise(1.0)
    return rows.crossJoin(one).withColumn("weight", F.least(F.greatest(base * boost, F.lit(1.0)), F.lit(8.0))).drop("__m", "__a", "__b")


def candidate_caps(train: DataFrame) -> DataFrame:
    """One row: three caps for counts, from a fixed one to high quantiles within bounds."""
    pos = F.when(F.col("y") > 0, F.col("y"))
    base = F.least(F.greatest(F.ceil(F.coalesce(F.percentile(pos, 0.995), F.lit(0.0))).cast("double"), F.lit(200.0)), F.lit(300.0))
    high = F.ceil(F.coalesce(F.percentile(pos, 0.999), F.lit(0.0))).cast("double")
    return train.agg(F.lit(200.0).alias("cap_low"), base.alias("cap_mid"), F.least(F.greatest(high, base, F.lit(200.0)), F.lit(400.0)).alias("cap_high"))
