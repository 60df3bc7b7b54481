"""Forecasters of single series. Each takes a dense training panel (sku, date, y) and gives a row per sku, or per sku and step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import post
from tallyloom.operators.history import horizon_index
from tallyloom.operators.panel import series
from tallyloom.session import ship


def naive7(train: DataFrame, future: DataFrame) -> DataFrame:
    """future with pred: the last seven values, repeated by position."""
    rn = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))
    last = train.withColumn("k", F.lit(8) - rn).where("k >= 1").select("sku", "k", F.col("y").alias("last"))
    steps = horizon_index(future).withColumn("k", (F.col("h") - 1) % 7 + 1)
    return steps.join(last, ["sku", "k"], "left").select(*future.columns, F.greatest(F.coalesce("last", F.lit(0.0)), F.lit(0.0)).alias("pred"))


def moving_average(train: DataFrame, w: int = 28) -> DataFrame:
    """The mean of the last w days."""
    rn = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))
    return train.withColumn("__rn", rn).where(F.col("__rn") <= w).groupBy("sku").agg(F.greatest(F.avg("y"), F.lit(0.0)).alias("pred"))


def _tsb(values: Column, p0: Column, d0: Column, alpha_p: float, alpha_d: float) -> Column:
    """Probability times demand after both are smoothed along a series: probability every day, demand on days with a sale."""
    start = F.struct(p0.cast("double").alias("p"), d0.cast("double").alias("d"))

    def step(acc: Column, v: Column) -> Column:
        sold = v > 0
        p = F.lit(alpha_p) * sold.cast("double") + F.lit(1.0 - alpha_p) * acc["p"]
        return F.struct(p.alias("p"), F.when(sold, F.lit(alpha_d) * v + F.lit(1.0 - alpha_d) * acc["d"]).otherwise(acc["d"]).alias("d"))

    return F.reduce(values, start, step, lambda acc: acc["p"] * acc["d"])


def tsb_first(train: DataFrame, alpha_p: float = 0.1, alpha_d: float = 0.2, threshold: float = 0.0) -> DataFrame:
    """Started from the first day and the first positive value, capped by recent history."""
    v = F.col("values")
    pos = F.filter(v, lambda x: x > 0)
    raw = F.when(F.size(pos) > 0, _tsb(v, (F.get(v, F.lit(0)) > 0).cast("double"), F.coalesce(F.get(pos, F.lit(0)), F.lit(0.0)), alpha_p, alpha_d)).otherwise(0.0)
    return series(train).select("sku", raw.alias("raw")).join(post.history_cap(train), "sku").select("sku", post.clean(F.col("raw"), threshold, F.col("cap")).alias("pred"))


def tsb_mean(train: DataFrame, alpha: float = 0.2, beta: float = 0.1) -> DataFrame:
    """Started from the mean sale rate (at least 1e-6) and the mean positive value."""
    v = F.col("values")
    pos = F.filter(v, lambda x: x > 0)
    add = lambda a: F.reduce(a, F.lit(0.0), lambda s, x: s + x)
    rate = F.least(F.greatest(F.try_divide(F.size(pos).cast("double"), F.size(v).cast("double")), F.lit(1e-6)), F.lit(1.0))
    raw = F.when(F.size(pos) > 0, _tsb(v, rate, F.coalesce(F.try_divide(add(pos), F.size(pos).cast("double")), F.lit(0.0)), beta, alpha)).otherwise(0.0)
    return series(train).select("sku", F.greatest(raw, F.lit(0.0)).alias("pred"))


def adida(train: DataFrame, k: int = 7, blocks: int = 4) -> DataFrame:
    """Sums over blocks of k days counted from the end (days before the first count as zero), the mean of the last blocks, per day."""
    rn = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))
    sums = train.withColumn("b", F.floor((rn - 1) / k)).groupBy("sku", "b").agg(F.sum("y").alias("s"))
    return sums.where(F.col("b") < blocks).groupBy("sku").agg(F.greatest(F.avg("s") / k, F.lit(0.0)).alias("pred"))


def imapa(train: DataFrame, sizes: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """The mean of adida over several block sizes."""
    parts = [adida(train, k).withColumn("k", F.lit(k)) for k in sizes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("sku").agg((F.sum("pred") / len(sizes)).alias("pred"))


def weekday_means(train: DataFrame, future: DataFrame, lookback: int = 56, recent: int = 28, shrink: float = 0.7, threshold: float = 0.0) -> DataFrame:
    """future with pred: each weekday's mean of the last days, drawn towards the mean of the most recent ones, capped."""
    rn = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))
    last = train.withColumn("__rn", rn).where(F.col("__rn") <= lookback)
    whole = last.groupBy("sku").agg(F.avg(F.when(F.col("__rn") <= recent, F.col("y"))).alias("g"))
    days = last.groupBy("sku", F.weekday("date").alias("wd")).agg(F.avg("y").alias("m"))
    joined = future.withColumn("wd", F.weekday("date")).join(whole, "sku", "left").join(days, ["sku", "wd"], "left").join(post.history_cap(train, 0.90, 1.5, lookback), "sku", "left")
    mixed = F.when(F.col("m").isNull(), F.col("g")).otherwise(F.lit(shrink) * F.col("m") + F.lit(1.0 - shrink) * F.col("g"))
    return joined.select(*future.columns, post.clean(mixed, threshold, F.coalesce("cap", F.lit(0.0))).alias("pred"))


def route(train: DataFrame, least_days: int = 28, least_sales: int = 6, least_rate: float = 0.05) -> DataFrame:
    """sku and model: fallback_short, fallback_sparse or tsb."""
    n_pos = F.count_if(F.col("y") > 0)
    counted = train.groupBy("sku").agg(F.count("*").alias("n"), n_pos.alias("n_pos"))
    return counted.select("sku", F.when(F.col("n") < least_days, "fallback_short").when((F.col("n_pos") < least_sales) | (F.col("n_pos") / F.col("n") < least_rate), "fallback_sparse").otherwise("tsb").alias("model"))


def routed(train: DataFrame, future: DataFrame) -> DataFrame:
    """future with model and pred: tsb where a series has enough sales, weekday means else."""
    chosen = future.join(route(train), "sku")
    flat = chosen.where("model = 'tsb'").join(tsb_first(train), "sku")
    rest = chosen.where("model <> 'tsb'")
    return flat.unionByName(weekday_means(train, rest))


def baselines(train: DataFrame) -> DataFrame:
    """sku, method, pred: all flat baselines as one long table."""
    parts = {"sma28": moving_average(train), "tsb": tsb_mean(train), "adida": adida(train), "imapa": imapa(train)}
    out = None
    for name, part in parts.items():
        rows = part.select("sku", F.lit(name).alias("method"), "pred")
        out = rows if out is None else out.unionByName(rows)
    return out


def holt_winters(values: np.ndarray, horizon: int, season: int = 7, alpha: float = 0.2, beta: float = 0.05, gamma: float = 0.2, damped: float = 0.98) -> tuple[np.ndarray, float]:
    """Additive level, damped trend and season of log1p values; the forecast, and the sum of squared one-step errors."""
    x = np.log1p(np.maximum(values, 0.0))
    if len(x) < 2 * season:
        return np.full(horizon, np.maximum(values, 0.0)[-season:].mean() if len(values) else 0.0), float("inf")
    level, slope = x[:season].mean(), (x[season : 2 * season].mean() - x[:season].mean()) / season
    seasonal, error = list(x[:season] - level), 0.0
    for t in range(season, len(x)):
        guess = level + damped * slope + seasonal[t % season]
        error += (x[t] - guess) ** 2
        before = level
        level = alpha * (x[t] - seasonal[t % season]) + (1 - alpha) * (level + damped * slope)
        slope = beta * (level - before) + (1 - beta) * damped * slope
        seasonal[t % season] = gamma * (x[t] - level) + (1 - gamma) * seasonal[t % season]
    fades = np.cumsum(damped ** np.arange(1, horizon + 1))
    out = level + slope * fades + np.array([seasonal[(len(x) + h) % season] for h in range(horizon)])
    return np.maximum(np.expm1(out), 0.0), float(error)


#: Smoothing settings among which each series' hold-out chooses: level, trend, season, damping.
SETTINGS = [(a, b, g, d) for a in (0.05, 0.2, 0.5) for b in (0.0, 0.05) for g in (0.05, 0.2) for d in (0.9, 0.98)]


def best_smoothing(values: np.ndarray, horizon: int, valid: int = 14) -> np.ndarray:
    """The forecast of the setting with the least weighted error and false sales on the last days, fitted on all."""
    if len(values) <= valid + 14:
        return holt_winters(values, horizon)[0]
    past, kept = values[:-valid], values[-valid:]

    def score(setting: tuple[float, ...]) -> float:
        guess = holt_winters(past, valid, 7, *setting)[0]
        zero = kept <= 0
        return 0.7 * np.abs(kept - guess).sum() / max(np.abs(kept).sum(), 1.0) + 0.3 * (float((guess[zero] > 0.5).mean()) if zero.any() else 0.0)

    return holt_winters(values, horizon, 7, *min(SETTINGS, key=score))[0]


def smoothing(train: DataFrame, horizon: int) -> DataFrame:
    """sku, h, pred by seasonal smoothing, its settings chosen per series."""
    return apply_forecaster(train, best_smoothing, horizon)


def apply_forecaster(train: DataFrame, forecaster: Callable[[np.ndarray, int], np.ndarray], horizon: int) -> DataFrame:
    """sku, h, pred of any function from a series' values and a horizon to that many values, one series at a time in Arrow batches."""
    ship(train.sparkSession)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("date")["y"].to_numpy(float)
        return pd.DataFrame({"sku": rows["sku"].iloc[0], "h": np.arange(1, horizon + 1, dtype=np.int32), "pred": np.asarray(forecaster(values, horizon), float)})

    return train.groupBy("sku").applyInPandas(each, "sku string, h int, pred double")


__all__ = ["adida", "apply_forecaster", "baselines", "holt_winters", "imapa", "moving_average", "naive7", "route", "routed", "smoothing", "tsb_first", "tsb_mean", "weekday_means"]
