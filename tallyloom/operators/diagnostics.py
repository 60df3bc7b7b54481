"""Tables behind forecast diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.metrics import ape, bias, wmape
from tallyloom.operators.panel import periods

QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def daily(df: DataFrame, group: str | None = None) -> DataFrame:
    """Sums by date (and group)."""
    return df.groupBy(*([group] if group else []), "date").agg(F.sum("y").alias("y"), F.sum("pred").alias("pred"))


def _by(group: str | None) -> Window:
    return Window.partitionBy(*([group] if group else [])).orderBy("date")


def residual_bands(totals: DataFrame, group: str | None = None, least: int = 7) -> DataFrame:
    """Forecast with a band of 1.96 standard deviations of the errors seen before (of all, while there are fewer than least)."""
    w = _by(group)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.withColumn("error", F.col("y") - F.col("pred"))
    whole = F.stddev_pop("error").over(Window.partitionBy(*([group] if group else [])))
    rows = rows.withColumn("sigma", F.coalesce(F.when(F.count("error").over(past) >= least, F.stddev_samp("error").over(past)), whole))
    return rows.withColumns({"low": F.col("pred") - 1.96 * F.col("sigma"), "high": F.col("pred") + 1.96 * F.col("sigma")})


def interval_width(totals: DataFrame, group: str | None = None, w: int = 7) -> DataFrame:
    """Widths of the bands, and their mean over w days once there are so many."""
    frame = _by(group).rowsBetween(-(w - 1), 0)
    rows = residual_bands(totals, group).withColumn("width", F.col("high") - F.col("low"))
    return rows.withColumn("rolling_width", F.when(F.count("width").over(frame) == w, F.avg("width").over(frame)))


def rolling_errors(totals: DataFrame, group: str | None = None, w: int = 7, eps: float = 1.0) -> DataFrame:
    """Residuals, and weighted and mean percentage errors over w days once there are so many."""
    frame = _by(group).rowsBetween(-(w - 1), 0)
    full = F.count("y").over(frame) == w
    e = F.abs(F.col("y") - F.col("pred"))
    return totals.withColumns(
        {
            "residual": F.col("y") - F.col("pred"),
            "rolling_residual": F.when(full, F.avg(F.col("y") - F.col("pred")).over(frame)),
            "rolling_wmape": F.when(full, F.sum(e).over(frame) / F.greatest(F.sum(F.abs("y")).over(frame), F.lit(eps)) * 100.0),
            "rolling_mape": F.when(full, F.avg(ape(F.col("y"), F.col("pred"), eps)).over(frame)),
        }
    )


def confusion(df: DataFrame, group: str = "period") -> DataFrame:
    """Sale days forecast and not, and days without a sale, counts and shares."""
    y, p = F.col("y") > 0, F.col("pred") > 0
    counts = df.groupBy(group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.count("*").alias("n"))
    return counts.select(group, "tp", "fp", "fn", "tn", *[F.try_divide(F.col(c) * 100.0, F.col("n")).alias(f"{c}_pct") for c in ("tp", "fp", "fn", "tn")])


def calibration(df: DataFrame, p: str = "p_sale", bins: int = 10) -> DataFrame:
    """Mean forecast probability and share of sale days by bins of equal width, closed on the right."""
    kept = df.where(F.col(p).between(0, 1)).withColumn("bin", F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int"))
    return kept.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg((F.col("y") > 0).cast("double")).alias("sale_rate"))


def error_by_state(df: DataFrame, eps: float = 1.0) -> DataFrame:
    """Errors of days with and without demand; days of net returns belong to neither."""
    state = F.when(F.col("y") == 0, "zero").when(F.col("y") > 0, "positive")
    return df.withColumn("state", state).where("state IS NOT NULL").groupBy("state").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"), F.avg(F.col("pred") - F.col("y")).alias("mean_error"), wmape(F.col("y"), F.col("pred"), eps).alias("wmape"))


def error_quantiles(df: DataFrame, group: list[str], qs: tuple[float, ...] = QUANTILES, eps: float = 1.0) -> DataFrame:
    """Quantiles of the absolute percentage error, a row each."""
    wide = df.withColumn("ape", ape(F.col("y"), F.col("pred"), eps)).groupBy(*group).agg(F.percentile("ape", list(qs)).alias("v"))
    return wide.select(*group, F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("v").alias("value"))).alias("r")).select(*group, "r.q", "r.value")


def trimmed_errors(df: DataFrame, group: str, q: float = 0.99, eps: float = 1.0) -> DataFrame:
    """Rows whose error is at most the group's quantile."""
    rows = df.withColumn("ape", ape(F.col("y"), F.col("pred"), eps))
    limit = rows.groupBy(group).agg(F.percentile("ape", q).alias("__limit"))
    return rows.join(F.broadcast(limit), group).where(F.col("ape") <= F.col("__limit")).drop("__limit")


def method_table(df: DataFrame, eps: float = 1.0) -> DataFrame:
    """A row per method with its weighted error and biases."""
    y, p = F.col("y"), F.col("pred")
    return df.groupBy("method").agg(wmape(y, p, eps).alias("wmape"), F.avg(F.abs(y - p)).alias("mae"), *bias(y, p, eps))


def shift_stats(df: DataFrame, columns: list[str], split: str = "split", clip: float = 0.99) -> DataFrame:
    """Per split and feature: mean, 90 % quantile, share of the never-sold mark, after clipping at the feature's quantile over all."""
    limits = F.broadcast(df.agg(*[F.percentile(c, clip).alias(f"__q_{c}") for c in columns]))  # one row
    wide = df.crossJoin(limits).groupBy(split).agg(*[f for c in columns for f in (F.avg(F.least(F.col(c).cast("double"), f"__q_{c}")).alias(f"{c}__mean"), F.percentile(c, 0.9).alias(f"{c}__p90"), F.avg((F.col(c) == 999).cast("double")).alias(f"{c}__never"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__p90").cast("double").alias("p90"), F.col(f"{c}__never").alias("never_share")) for c in columns]))
    return wide.select(split, each.alias("r")).select(split, "r.*")


def long_methods(df: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """keys, method, pred from one column per method."""
    return df.unpivot(keys, methods, "method", "pred")


def labelled_methods(df: DataFrame, labels: dict[str, str], method: str = "method") -> DataFrame:
    """df with method names as readers know them; a name without a label loses its "pred_" and underscores."""
    own = F.col(method)
    bare = F.initcap(F.replace(F.regexp_replace(own, "^pred_", ""), F.lit("_"), F.lit(" ")))
    known = bare
    for name, label in labels.items():
        known = F.when(own == name, label).otherwise(known)
    return df.withColumn(method, known)


def analysis(df: DataFrame, methods: list[str], p_sale: str | None = None, n_periods: int = 4, eps: float = 1.0) -> dict[str, DataFrame]:
    """The tables of one evaluation, each described and none computed: of rows sku, date, y and a column per method, by method."""
    keys = ["sku", "date", "y", *([p_sale] if p_sale else [])]
    rows = long_methods(df, keys, methods).join(F.broadcast(periods(df, n_periods)), "date")
    by_method = rows.withColumn("whole", F.concat_ws(" ", "method", "period"))
    first = rows.where(F.col("method") == methods[0])
    return {
        "methods": method_table(rows, eps),
        "periods": rows.groupBy("method", "period").agg(wmape(F.col("y"), F.col("pred"), eps).alias("wmape"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"), F.count("*").alias("n")),
        "quantiles": error_quantiles(rows, ["method"], eps=eps),
        "positive_quantiles": error_quantiles(rows.where("y > 0"), ["method"], eps=eps),
        "confusion": confusion(by_method, "whole"),
        "states": error_by_state(first, eps),
        "rolling": rolling_errors(daily(rows, "method"), "method", eps=eps),
        "bands": residual_bands(daily(rows, "method"), "method"),
    } | ({"calibration": calibration(first, p_sale)} if p_sale else {})


def evaluate(df: DataFrame, method: str = "pred", **options) -> dict[str, DataFrame]:
    """analysis() of a single model."""
    return analysis(df, [method], **options)
