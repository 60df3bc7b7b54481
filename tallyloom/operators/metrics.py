"""Forecast errors, each as one aggregate over (y, pred); rows where either is missing or infinite don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def scored(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Rows that count."""
    return df.where(_finite(F.col(y)) & _finite(F.col(pred)))


def ape(y: Column, pred: Column, eps: float = 1.0) -> Column:
    """Absolute percentage error over at least eps."""
    return F.abs(y - pred) / F.greatest(F.abs(y), F.lit(eps)) * 100.0


def wmape(y: Column, pred: Column, eps: float = 1.0) -> Column:
    return F.sum(F.abs(y - pred)) / F.greatest(F.sum(F.abs(y)), F.lit(eps)) * 100.0


def f1(y: Column, pred: Column) -> Column:
    """Of sale days; 0 where precision and recall are both 0 or undefined."""
    tp = F.count_if((y > 0) & (pred > 0))
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + F.count_if((y <= 0) & (pred > 0)) + F.count_if((y > 0) & (pred <= 0))), F.lit(0.0))


def false_positive_rate(y: Column, pred: Column, threshold: float = 0.0) -> Column:
    """Of days without a sale; null without such days."""
    return F.try_divide(F.count_if((y <= 0) & (pred > threshold)), F.count_if(y <= 0))


def recall(y: Column, pred: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if((y > 0) & (pred > 0)), F.count_if(y > 0)), F.lit(0.0))


def under_forecast(y: Column, pred: Column, eps: float = 1.0) -> Column:
    """Mean shortfall on sale days, in per cent."""
    return F.avg(F.when(y > 0, F.greatest(y - pred, F.lit(0.0)) / F.greatest(F.abs(y), F.lit(eps)) * 100.0))


def overshoot(y: Column, pred: Column, threshold: float = 0.0, q: float = 0.5, eps: float = 1.0) -> Column:
    """Mean of what is forecast beyond the threshold on days without a sale, over a quantile of sale days; 0 without such days."""
    over = F.avg(F.when((y <= 0) & (pred > threshold), pred))
    return F.coalesce(over / F.greatest(F.coalesce(F.percentile(F.when(y > 0, y), q), F.lit(0.0)), F.lit(eps)) * 100.0, F.lit(0.0))


METRICS = ("MAPE_0_100", "EPSILON_MAPE_PCT", "CAP_MAPE_0_100", "POSITIVE_ONLY_MAPE_PCT", "WMAPE_0_100", "OCCURRENCE_F1", "ZERO_DAY_FPR", "MAE", "RMSE")


def bundle(y: str = "y", pred: str = "pred", eps: float = 1.0, cap: float = 100.0, main: str = "bounded_mape") -> list[Column]:
    """The named metrics as aggregates for one pass. main chooses which mean error goes first."""
    if eps <= 0 or cap <= 0:
        raise ValueError("eps and cap must be positive")
    if main not in ("bounded_mape", "safe_mape"):
        raise ValueError("main must be bounded_mape or safe_mape")
    a, p = F.col(y), F.col(pred)
    each = ape(a, p, eps)
    capped, safe = F.avg(F.least(each, F.lit(cap))), F.avg(each)
    values = (capped if main == "bounded_mape" else safe, safe, capped, F.avg(F.when(a > 0, each)), wmape(a, p, eps), f1(a, p), false_positive_rate(a, p), F.avg(F.abs(a - p)), F.sqrt(F.avg(F.pow(a - p, 2))))
    return [v.alias(n) for v, n in zip(values, METRICS, strict=True)]


def by_sku(df: DataFrame, **options) -> DataFrame:
    """The metrics of each sku with its days, sale days and sums."""
    return scored(df).groupBy("sku").agg(*bundle(**options), F.count("*").alias("n_days"), F.count_if(F.col("y") > 0).alias("nonzero_days"), F.sum("y").alias("actual_sum"), F.sum("pred").alias("pred_sum"))


def by_levels(df: DataFrame, levels: list[list[str]], **options) -> DataFrame:
    """The metrics at several levels of grouping (GROUPING SETS), one pass over the rows."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    return scored(df).groupingSets(levels, *columns).agg(*bundle(**options), F.count("*").alias("n_days"))


def bias(y: Column, pred: Column, eps: float = 1.0) -> list[Column]:
    """Signed and distributional measures of a method."""
    each = ape(y, pred, eps)
    return [
        F.avg((pred - y) / F.greatest(F.abs(y), F.lit(eps)) * 100.0).alias("mpe_pct"),
        (F.abs(F.sum(pred - y)) / F.greatest(F.sum(F.abs(y)), F.lit(eps))).alias("bias_ratio"),
        (F.avg((pred > 0).cast("double")) - F.avg((y > 0).cast("double"))).alias("nonzero_rate_gap"),
        F.percentile(each, 0.9).alias("ape_p90"),
        F.percentile(each, 0.95).alias("ape_p95"),
    ]


def flatness(df: DataFrame, level: float = 0.45, diff: float = 0.5, eps: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of by): the penalty for daily totals that vary less, or move less from day to day, than the actual ones."""
    daily = df.groupBy(*by, "date").agg(F.sum("y").alias("a"), F.sum("pred").alias("p"))
    order = Window.partitionBy(*by).orderBy("date")
    moved = daily.withColumns({"da": F.col("a") - F.lag("a").over(order), "dp": F.col("p") - F.lag("p").over(order)})  # a row per day
    short = lambda least, p, a: F.greatest(F.lit(0.0), F.lit(least) - F.stddev_pop(p) / F.greatest(F.stddev_pop(a), F.lit(eps)))
    return moved.groupBy(*by).agg((100.0 * (short(level, "p", "a") + 1.25 * F.coalesce(short(diff, "dp", "da"), F.lit(0.0)))).alias("flatness"))
