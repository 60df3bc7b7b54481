"""Statistics of demand series: intermittency, autocorrelation, trend, peaks, runs, spectra and tests.

What windows and aggregates express is Catalyst; spectrum, partial autocorrelation, seasonal strength and the unit-root tests are numeric
recurrences and run per sku in Arrow batches, a series (some thousand days) at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.decomposition import strength, strengths
from tallyloom.operators.history import by
from tallyloom.operators.unitroot import adf
from tallyloom.session import materialize, ship


def intermittency(panel: DataFrame) -> DataFrame:
    """Of positive days: adi (mean distance; n without two), cv2 (population), and counts."""
    pos = F.when(F.col("y") > 0, F.col("y"))
    rows = panel.withColumn("__t", F.row_number().over(by()))
    place = F.when(F.col("y") > 0, F.col("__t"))
    n = F.count(pos)
    return rows.groupBy("sku").agg(
        F.count("*").alias("n"),
        n.alias("n_pos"),
        F.when(n > 1, (F.max(place) - F.min(place)) / (n - 1)).otherwise(F.count("*").cast("double")).alias("adi"),
        F.when(n > 1, F.pow(F.try_divide(F.stddev_pop(pos), F.avg(pos)), 2)).alias("cv2"),
    )


def demand_summary(panel: DataFrame) -> DataFrame:
    """Mean positive demand, mean interval, sale probability, and the forecasts demand/interval and probability x demand."""
    base = intermittency(panel)
    pos = panel.groupBy("sku").agg(F.avg(F.when(F.col("y") > 0, F.col("y"))).alias("demand"))
    joined = base.join(pos, "sku")
    has = F.col("n_pos") > 0
    p = F.col("n_pos") / F.col("n")
    return joined.select(
        "sku", F.when(has, F.col("demand")).alias("demand"), F.when(has, F.col("adi")).alias("interval"),
        F.when(has, F.try_divide("demand", "adi")).otherwise(0.0).alias("croston"), F.when(has, p).otherwise(0.0).alias("probability"), F.when(has, p * F.col("demand")).otherwise(0.0).alias("tsb"),
    )


def autocorrelation(panel: DataFrame, lags: tuple[int, ...] = (1, 7, 14, 30)) -> DataFrame:
    """Pearson correlation with the lagged series over their overlap: 0 for constants, null where there is no overlap."""
    rows = panel.withColumns({f"__l{k}": F.lag("y", k).over(by()) for k in lags})

    def one(k: int) -> Column:
        lagged = F.col(f"__l{k}")
        both = F.when(lagged.isNotNull(), F.col("y"))
        # corr() fails on constants; the quotient is undefined there, and 0
        corr = F.coalesce(F.try_divide(F.covar_pop(both, lagged), F.stddev_pop(both) * F.stddev_pop(lagged)), F.lit(0.0))
        return F.when(F.count("*") > k, corr).alias(f"acf_{k}")

    return rows.groupBy("sku").agg(*[one(k) for k in lags])


def trend(panel: DataFrame, w: int = 7, least: int = 3) -> DataFrame:
    """Slope of the rolling mean over time, and its change from first to last; days with too few before count as 0."""
    frame = by().rowsBetween(-(w - 1), 0)
    rows = panel.withColumns({"__m": F.when(F.count("y").over(frame) >= least, F.avg("y").over(frame)).otherwise(0.0), "__t": (F.row_number().over(by()) - 1).cast("double")})
    return rows.groupBy("sku").agg(F.regr_slope("__m", "__t").alias("slope"), (F.max_by("__m", "__t") - F.min_by("__m", "__t")).alias("growth"))


def roll_ratio(panel: DataFrame, w: int = 7, least: int = 3) -> DataFrame:
    """Mean of rolling deviation over rolling mean, where the mean isn't 0."""
    frame = by().rowsBetween(-(w - 1), 0)
    enough = F.count("y").over(frame) >= least
    rows = panel.withColumn("__r", F.when(enough, F.try_divide(F.stddev_samp("y").over(frame), F.nullif(F.avg("y").over(frame), F.lit(0.0)))))
    return rows.groupBy("sku").agg(F.avg("__r").alias("roll_ratio"))


def peaks(panel: DataFrame, q: float = 0.95) -> DataFrame:
    """The quantile of positive days, and the days at or above it; 0 where there are none."""
    size = panel.where("y > 0").groupBy("sku").agg(F.percentile("y", q).alias("peak_size"))
    joined = panel.join(size, "sku", "left")
    return joined.groupBy("sku").agg(F.coalesce(F.max("peak_size"), F.lit(0.0)).alias("peak_size"), F.count_if(F.col("y") >= F.col("peak_size")).alias("peak_days"))


def longest_zero_run(panel: DataFrame) -> DataFrame:
    """Islands of zero days: a run keeps the difference of two row numbers."""
    rows = panel.withColumn("__rn", F.row_number().over(by())).withColumn("__island", F.col("__rn") - F.row_number().over(Window.partitionBy("sku", F.col("y") == 0).orderBy("date")))
    runs = rows.groupBy("sku", "__island", (F.col("y") == 0).alias("zero")).agg(F.count("*").alias("n"))
    return runs.groupBy("sku").agg(F.coalesce(F.max(F.when(F.col("zero"), F.col("n"))), F.lit(0)).alias("longest_zero_streak"))


def level(panel: DataFrame) -> DataFrame:
    """Totals, coefficient of variation, shares of non-zero and of negative days, mean gap of non-zero days."""
    rows = panel.withColumn("__t", F.row_number().over(by()))
    place = F.when(F.col("y") != 0, F.col("__t"))
    return rows.groupBy("sku").agg(
        F.sum("y").alias("total_sales"), F.avg("y").alias("mean_daily"), F.coalesce(F.try_divide(F.stddev_pop("y"), F.nullif(F.avg("y"), F.lit(0.0))), F.lit(0.0)).alias("cv"),
        F.avg((F.col("y") != 0).cast("double")).alias("nonzero_rate"), F.avg((F.col("y") < 0).cast("double")).alias("neg_day_rate"),
        F.when(F.count(place) > 1, (F.max(place) - F.min(place)) / (F.count(place) - 1)).otherwise(F.count("*").cast("double")).alias("avg_gap"),
    )


def ar1(panel: DataFrame) -> DataFrame:
    """Coefficient and residual variance of y on its lag."""
    rows = panel.withColumn("__l", F.lag("y", 1).over(by())).where("__l IS NOT NULL")
    fit = rows.groupBy("sku").agg(F.regr_slope("y", "__l").alias("phi"), F.regr_syy("y", "__l").alias("syy"), F.regr_sxy("y", "__l").alias("sxy"), F.count("*").alias("n"))
    return fit.select("sku", "phi", ((F.col("syy") - F.col("phi") * F.col("sxy")) / F.col("n")).alias("resid_var"))


def weekly_intermittency(weekly: DataFrame) -> DataFrame:
    """On weekly series: weeks, weeks with demand, adi = weeks per such week (infinite without), cv2 with sample deviation (0 for one
    such week, null without)."""
    pos = F.when(F.col("y") > 0, F.col("y"))
    n = F.count(pos)
    return weekly.groupBy("sku").agg(
        F.count("*").alias("weeks"), n.alias("nonzero_weeks"), F.when(n > 0, F.count("*") / n).otherwise(F.lit(float("inf"))).alias("adi"),
        F.when(n > 1, F.pow(F.stddev_samp(pos) / F.avg(pos), 2)).when(n == 1, 0.0).alias("cv2"),
    )


def spikes(weekly: DataFrame, least: int = 4) -> DataFrame:
    """The 95 % quantile over the median of weeks with demand; null below so many of these."""
    pos = F.when(F.col("y") > 0, F.col("y"))
    return weekly.groupBy("sku").agg(F.when(F.count(pos) >= least, F.percentile("y", 0.95) / (F.median(pos) + 1e-6)).alias("spike_score"))


def spectrum(values: np.ndarray) -> tuple[float | None, float | None]:
    """Period of the strongest frequency, and the normalised entropy of the power spectrum; None for short or constant series."""
    if len(values) < 8 or values.std() == 0:
        return None, None
    power = np.abs(np.fft.rfft(values - values.mean())) ** 2
    power, freq = power[1:], np.fft.rfftfreq(len(values))[1:]
    p = power / power.sum()
    return float(1 / freq[power.argmax()]), float(-(p * np.log(p + 1e-12)).sum() / math.log(len(p)))


def partial_autocorrelations(values: np.ndarray, most: int) -> np.ndarray:
    """By Levinson-Durbin on biased autocovariances; NaN where the series is too short or constant."""
    n, x = len(values), values - values.mean()
    out = np.full(most + 1, np.nan)
    if n <= most + 1 or not x.any():
        return out
    r = np.array([x[: n - k] @ x[k:] for k in range(most + 1)]) / n
    phi, error = np.zeros(0), r[0]
    for k in range(1, most + 1):
        reflect = (r[k] - phi @ r[k - 1 : 0 : -1]) / error if k > 1 else r[1] / error
        phi = np.append(phi - reflect * phi[::-1], reflect)
        error *= 1 - reflect**2
        out[k] = reflect
        if error <= 0:
            break
    return out


def _chi2_above(x: float, k: int) -> float:
    """Upper tail of a chi-squared variable, by the regularised incomplete gamma function's series or continued fraction."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return scale * h


def ljung_box(values: np.ndarray, most: int = 12) -> float:
    """p-value of no autocorrelation up to min(most, n - 1) lags; 1 for series too short or constant."""
    n = len(values)
    k = min(most, n - 1)
    x = values - values.mean() if n else values
    if k < 2 or not (x @ x):
        return 1.0
    r = np.array([x[: n - j] @ x[j:] for j in range(1, k + 1)]) / (x @ x)
    return _chi2_above(n * (n + 2) * float((r**2 / (n - np.arange(1, k + 1))).sum()), k)


def kpss(values: np.ndarray) -> float | None:
    """p-value of level stationarity, interpolated between the four tabled ones and cut at them; None for short or constant series."""
    n = len(values)
    if n < 20 or values.std() == 0:
        return None
    x = values - values.mean()
    lags = min(n - 1, int(math.ceil(12 * (n / 100) ** 0.25)))
    scale = (x @ x + 2 * sum((1 - k / (lags + 1)) * (x[: n - k] @ x[k:]) for k in range(1, lags + 1))) / n
    if scale <= 0:
        return None
    eta = float((x.cumsum() ** 2).sum() / n**2 / scale)
    return float(np.interp(eta, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))


def numeric_features(panel: DataFrame, period: int = 7) -> DataFrame:
    """dominant_period, spectral_entropy, pacf_1/7/14, seasonal_strength (robust STL), adf_p and adf_lags, kpss_p and ljung_box_p of each sku."""
    ship(panel.sparkSession)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("date")["y"].to_numpy(float)
        cycle, entropy = spectrum(y)
        pacf = partial_autocorrelations(y, 14)
        _, root, lags = adf(y)
        values = {"dominant_period": cycle, "spectral_entropy": entropy, **{f"pacf_{k}": None if np.isnan(pacf[k]) else pacf[k] for k in (1, 7, 14)}, "seasonal_strength": strength(y, period), "adf_p": root, "adf_lags": lags, "kpss_p": kpss(y), "ljung_box_p": ljung_box(y)}
        return pd.DataFrame([{"sku": rows["sku"].iloc[0], **values}])

    columns = ["dominant_period", "spectral_entropy", "pacf_1", "pacf_7", "pacf_14", "seasonal_strength", "adf_p", "adf_lags", "kpss_p", "ljung_box_p"]
    return panel.groupBy("sku").applyInPandas(each, "sku string, " + ", ".join(f"{c} double" for c in columns))


def weekly_strength(weekly: DataFrame, period: int = 52, batch: int = 100) -> DataFrame:
    """sku and seasonal_strength of weekly series (sku, week, y) by robust STL; 0 below a period and for series without variation. About
    `batch` series of a task are decomposed together, those of equal length as one array."""
    ship(weekly.sparkSession)
    values = F.transform(F.array_sort(F.collect_list(F.struct("week", F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y")))), lambda r: r["y"])
    rows = materialize(weekly.groupBy("sku").agg(values.alias("series")), "weeks")
    bucket = F.pmod(F.xxhash64("sku"), F.lit(max(1, -(-rows.count() // batch))))

    def each(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, same in group.groupby(group["series"].map(len)):
            y = np.stack(same["series"].to_list()).astype(float)
            out.append(pd.DataFrame({"sku": same["sku"], "seasonal_strength": strengths(y, period) if n >= period else 0.0}))
        return pd.concat(out)

    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(each, "sku string, seasonal_strength double")
