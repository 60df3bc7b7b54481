"""Forecast errors and diagnostic tables of the weekly-pattern baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import diagnostics as D
from tallyloom.operators import history as H
from tallyloom.operators import metrics as M
from tallyloom.operators import panel as P
from tallyloom.operators import univariate as U
from tallyloom.plans.panels import rounded, split
from tallyloom.plans.registry import query


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, date, y, pred, period."""
    train, test = split(spark, sf_dir)
    return U.naive7(train, test).join(F.broadcast(P.periods(test)), "date")  # a row per date


_APE = "abs(y - pred) / greatest(abs(y), 1) * 100"
_F1 = "coalesce(2.0 * count(*) FILTER (WHERE y > 0 AND pred > 0) / nullif(2 * count(*) FILTER (WHERE y > 0 AND pred > 0) + count(*) FILTER (WHERE y <= 0 AND pred > 0) + count(*) FILTER (WHERE y > 0 AND pred <= 0), 0), 0)"
_WMAPE = "sum(abs(y - pred)) / greatest(sum(abs(y)), 1) * 100"
_BUNDLE = f"""round(avg(least({_APE}, 100)), 4) AS "MAPE_0_100", round(avg({_APE}), 4) AS "EPSILON_MAPE_PCT", round(avg(least({_APE}, 100)), 4) AS "CAP_MAPE_0_100", round(avg({_APE}) FILTER (WHERE y > 0), 4) AS "POSITIVE_ONLY_MAPE_PCT",
    round({_WMAPE}, 4) AS "WMAPE_0_100", round({_F1}, 4) AS "OCCURRENCE_F1", round(count(*) FILTER (WHERE y <= 0 AND pred > 0) / nullif(count(*) FILTER (WHERE y <= 0), 0), 4) AS "ZERO_DAY_FPR", round(avg(abs(y - pred)), 4) AS "MAE", round(sqrt(avg(pow(y - pred, 2))), 4) AS "RMSE" """


@query(f"SELECT period, round({_WMAPE}, 4) AS wmape, round(avg(least({_APE}, 100)), 4) AS bounded_mape, CAST(count(*) AS BIGINT) AS n_days FROM scored GROUP BY 1", "scored")
def wmape_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, pred = F.col("y"), F.col("pred")
    rows = scored(spark, sf_dir).groupBy("period").agg(M.wmape(y, pred).alias("wmape"), F.avg(F.least(M.ape(y, pred), F.lit(100.0))).alias("bounded_mape"), F.count("*").alias("n_days"))
    return rounded(rows, 4)


@query(f"SELECT {_BUNDLE} FROM scored", "scored")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.scored(scored(spark, sf_dir)).agg(*M.bundle()), 4)


@query(f"SELECT period, {_BUNDLE}, CAST(count(*) AS BIGINT) AS n_days FROM scored GROUP BY GROUPING SETS ((), (period))", "scored")
def metric_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.by_levels(scored(spark, sf_dir), [[], ["period"]]), 4)


@query(f"SELECT sku, {_BUNDLE}, CAST(count(*) AS BIGINT) AS n_days, CAST(count(*) FILTER (WHERE y > 0) AS BIGINT) AS nonzero_days, round(sum(y), 4) AS actual_sum, round(sum(pred), 4) AS pred_sum FROM scored GROUP BY 1", "scored")
def metric_by_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.by_sku(scored(spark, sf_dir)), 4)


@query(f"SELECT round(avg(w), 4) AS sku_wmape_mean, round(avg(m), 4) AS sku_mae_mean FROM (SELECT sku, {_WMAPE} AS w, avg(abs(y - pred)) AS m FROM scored GROUP BY 1)", "scored")
def metric_sku_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.by_sku(scored(spark, sf_dir))
    return rows.agg(F.round(F.avg("WMAPE_0_100"), 4).alias("sku_wmape_mean"), F.round(F.avg("MAE"), 4).alias("sku_mae_mean"))


@query(f"WITH e AS (SELECT *, {_APE} AS ape FROM scored) SELECT period, CAST(count(*) AS BIGINT) AS n, round(avg(ape), 4) AS mean_ape, round(max(ape), 4) AS max_ape FROM e JOIN (SELECT period, quantile_cont(ape, 0.99) AS q FROM e GROUP BY 1) USING (period) WHERE ape <= q GROUP BY 1", "scored")
def ape_box_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.trimmed_errors(scored(spark, sf_dir), "period")
    return rounded(kept.groupBy("period").agg(F.count("*").alias("n"), F.avg("ape").alias("mean_ape"), F.max("ape").alias("max_ape")), 4)


@query(" UNION ALL ".join(f"SELECT period, {q}::DOUBLE AS q, round(quantile_cont({_APE}, {q}), 4) AS value FROM scored GROUP BY 1" for q in D.QUANTILES), "scored")
def error_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.error_quantiles(scored(spark, sf_dir), ["period"]).withColumn("value", F.round("value", 4))


_DAILY = "d AS (SELECT date, round(sum(y), 2) AS y, round(sum(pred), 2) AS pred FROM scored GROUP BY 1)"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = D.daily(scored(spark, sf_dir))
    return sums.select("date", F.round("y", 2).alias("y"), F.round("pred", 2).alias("pred"))


@query(f"WITH {_DAILY} SELECT date, round(y - pred, 2) AS residual, CASE WHEN count(*) OVER w = 7 THEN round(avg(y - pred) OVER w, 4) END AS rolling_residual, CASE WHEN count(*) OVER w = 7 THEN round(sum(abs(y - pred)) OVER w / greatest(sum(abs(y)) OVER w, 1) * 100, 4) END AS rolling_wmape, CASE WHEN count(*) OVER w = 7 THEN round(avg({_APE}) OVER w, 4) END AS rolling_mape FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", "scored")
def rolling_wmape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.rolling_errors(totals(spark, sf_dir))
    return rows.select("date", F.round("residual", 2).alias("residual"), *[F.round(c, 4).alias(c) for c in ("rolling_residual", "rolling_wmape", "rolling_mape")])


_BANDS = f"""{_DAILY}, b AS (SELECT *, coalesce(CASE WHEN count(*) OVER w >= 7 THEN stddev_samp(y - pred) OVER w END, stddev_pop(y - pred) OVER ()) AS sigma FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_BANDS} SELECT date, round(sigma, 4) AS sigma, round(pred - 1.96 * sigma, 4) AS low, round(pred + 1.96 * sigma, 4) AS high FROM b", "scored")
def residual_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.residual_bands(totals(spark, sf_dir)).select("date", "sigma", "low", "high"), 4)


@query(f"WITH {_BANDS} SELECT date, round(2 * 1.96 * sigma, 3) AS width, CASE WHEN count(*) OVER w = 7 THEN round(avg(2 * 1.96 * sigma) OVER w, 3) END AS rolling_width FROM b WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", "scored")
def interval_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.interval_width(totals(spark, sf_dir)).select("date", "width", "rolling_width"), 3)


_C = {"tp": "y > 0 AND pred > 0", "fp": "y <= 0 AND pred > 0", "fn": "y > 0 AND pred <= 0", "tn": "y <= 0 AND pred <= 0"}


@query(f"SELECT period, {', '.join(f'CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {n}, round(count(*) FILTER (WHERE {c}) * 100.0 / count(*), 4) AS {n}_pct' for n, c in _C.items())} FROM scored GROUP BY 1", "scored")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.confusion(scored(spark, sf_dir)), 4)


@query(
    """WITH r AS (SELECT sku, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS p_sale FROM train GROUP BY 1)
    SELECT CAST(greatest(ceil(p_sale * 10), 1) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p_sale), 6) AS mean_p, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS sale_rate FROM test JOIN r USING (sku) GROUP BY 1""",
    "train test",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    rates = train.groupBy("sku").agg(F.avg((F.col("y") > 0).cast("double")).alias("p_sale"))
    return rounded(D.calibration(test.join(rates, "sku")))


@query(f"SELECT CASE WHEN y = 0 THEN 'zero' ELSE 'positive' END AS state, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - pred)), 4) AS mae, round(avg(pred - y), 4) AS mean_error, round({_WMAPE}, 4) AS wmape FROM scored WHERE y >= 0 GROUP BY 1", "scored")
def error_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.error_by_state(scored(spark, sf_dir)), 4)


_FLAT = "SELECT sku, greatest(avg(y), 0) AS flat FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS rn FROM train) WHERE rn <= 28 GROUP BY 1"


@query(
    f"""WITH m AS (SELECT sku, date, y, pred, 'naive7' AS method FROM naive UNION ALL SELECT sku, date, y, flat, 'sma28' FROM test JOIN ({_FLAT}) USING (sku))
    SELECT method, round({_WMAPE}, 4) AS wmape, round(avg(abs(y - pred)), 4) AS mae, round(avg((pred - y) / greatest(abs(y), 1) * 100), 4) AS mpe_pct, round(abs(sum(pred - y)) / greatest(sum(abs(y)), 1), 6) AS bias_ratio,
    round(avg(CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero_rate_gap, round(quantile_cont({_APE}, 0.9), 4) AS ape_p90, round(quantile_cont({_APE}, 0.95), 4) AS ape_p95 FROM m GROUP BY 1""",
    "naive",
)
def method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    wide = U.naive7(train, test).withColumnRenamed("pred", "naive7").join(U.moving_average(train).withColumnRenamed("pred", "sma28"), "sku")
    rows = D.method_table(D.long_methods(wide, ["sku", "date", "y"], ["naive7", "sma28"]))
    return rows.select("method", *[F.round(c, 6 if c in ("bias_ratio", "nonzero_rate_gap") else 4).alias(c) for c in rows.columns[1:]])


@query(
    f"""WITH {_DAILY}, m AS (SELECT *, y - lag(y) OVER (ORDER BY date) AS dy, pred - lag(pred) OVER (ORDER BY date) AS dp FROM d)
    SELECT round(100 * (greatest(0, 0.45 - stddev_pop(pred) / greatest(stddev_pop(y), 1)) + 1.25 * greatest(0, 0.5 - stddev_pop(dp) / greatest(stddev_pop(dy), 1))), 6) AS flatness FROM m""",
    "scored",
)
def flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.flatness(totals(spark, sf_dir)))


@query(
    """WITH f AS (SELECT split, CAST(since AS DOUBLE) AS since, lag_1 FROM (SELECT *, coalesce(lag(y, 1) OVER w, 0) AS lag_1, coalesce(date - max(CASE WHEN y > 0 THEN date END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS since
        FROM (SELECT *, 'train' AS split FROM train UNION ALL SELECT *, 'test' FROM test) WINDOW w AS (PARTITION BY sku ORDER BY date))),
    q AS (SELECT quantile_cont(since, 0.99) AS s, quantile_cont(lag_1, 0.99) AS l FROM f)
    SELECT split, 'since' AS feature, round(avg(least(since, s)), 4) AS mean, round(quantile_cont(since, 0.9), 4) AS p90, round(avg(CASE WHEN since = 999 THEN 1.0 ELSE 0.0 END), 6) AS never_share FROM f, q GROUP BY 1
    UNION ALL SELECT split, 'lag_1', round(avg(least(lag_1, l)), 4), round(quantile_cont(lag_1, 0.9), 4), round(avg(CASE WHEN lag_1 = 999 THEN 1.0 ELSE 0.0 END), 6) FROM f, q GROUP BY 1""",
    "train test",
)
def shift_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    y = F.col("y")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))).select("split", H.days_since_sale(y).alias("since"), H.lag(y, 1).alias("lag_1"))
    rows = D.shift_stats(both, ["since", "lag_1"])
    return rows.select("split", "feature", F.round("mean", 4).alias("mean"), F.round("p90", 4).alias("p90"), F.round("never_share", 6).alias("never_share"))


@query(
    f"""SELECT round(coalesce(avg(pred) FILTER (WHERE y <= 0 AND pred > 0) / greatest(quantile_cont(y, 0.5) FILTER (WHERE y > 0), 1) * 100, 0), 4) AS overshoot,
    round(count(*) FILTER (WHERE y > 0 AND pred > 0) / count(*) FILTER (WHERE y > 0), 6) AS recall, round(avg(greatest(y - pred, 0) / greatest(abs(y), 1) * 100) FILTER (WHERE y > 0), 4) AS under FROM scored""",
    "scored",
)
def sale_day_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, pred = F.col("y"), F.col("pred")
    return scored(spark, sf_dir).agg(F.round(M.overshoot(y, pred), 4).alias("overshoot"), F.round(M.recall(y, pred), 6).alias("recall"), F.round(M.under_forecast(y, pred), 4).alias("under"))


@query(
    f"""WITH p AS (SELECT period, round({_WMAPE}, 4) AS w FROM scored GROUP BY 1) SELECT 'naive7' AS method, max(w) FILTER (WHERE period = 'P1') AS P1, max(w) FILTER (WHERE period = 'P2') AS P2, max(w) FILTER (WHERE period = 'P3') AS P3, max(w) FILTER (WHERE period = 'P4') AS P4 FROM p""",
    "scored",
)
def period_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("method", F.lit("naive7"))
    return rows.groupBy("method").pivot("period", ["P1", "P2", "P3", "P4"]).agg(F.round(M.wmape(F.col("y"), F.col("pred")), 4))


@query(f"SELECT method, CAST(rank AS INTEGER) AS rank FROM (SELECT method, row_number() OVER (ORDER BY w, method) AS rank FROM (SELECT 'naive7' AS method, {_WMAPE} AS w FROM naive UNION ALL SELECT 'sma28', {_WMAPE.replace('pred', 'flat')} FROM test JOIN ({_FLAT}) USING (sku)))", "naive")
def method_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection of a method by its error on the last days: a row per method, so ranking is over a handful of rows."""
    train, test = split(spark, sf_dir)
    wide = U.naive7(train, test).withColumnRenamed("pred", "naive7").join(U.moving_average(train).withColumnRenamed("pred", "sma28"), "sku")
    rows = D.long_methods(wide, ["sku", "date", "y"], ["naive7", "sma28"]).groupBy("method").agg(M.wmape(F.col("y"), F.col("pred")).alias("w"))
    return rows.select("method", F.row_number().over(Window.orderBy("w", "method")).alias("rank"))
