"""Forecasts of single series, caps, gates and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import panel as P
from tallyloom.operators import post
from tallyloom.operators import smoothing as M
from tallyloom.operators import univariate as U
from tallyloom.plans.panels import TEST_DAYS, dense, rounded, split
from tallyloom.plans.registry import ORACLES, query

_LAST = "SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS rn FROM train"


@query("SELECT sku, date, y, pred FROM naive", "naive")
def naive7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.naive7(*split(spark, sf_dir))


@query(f"SELECT sku, round(greatest(avg(y), 0), 6) AS pred FROM ({_LAST}) WHERE rn <= 28 GROUP BY 1", "train")
def sma28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.moving_average(split(spark, sf_dir)[0]))


_CAP = "SELECT sku, coalesce(greatest(0, least(greatest(quantile_cont(y, {q}) FILTER (WHERE y > 0), avg(y) FILTER (WHERE y > 0) * 1.5), max(y) FILTER (WHERE y > 0) * 1.5)), 0) AS cap FROM (" + _LAST + ") WHERE rn <= 56 GROUP BY 1"


@query(f"SELECT sku, round(cap, 6) AS cap FROM ({_CAP.format(q=0.95)})", "train")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(post.history_cap(split(spark, sf_dir)[0]))


_SERIES = "SELECT sku, list(y ORDER BY date) AS v, list(y ORDER BY date) FILTER (WHERE y > 0) AS pos, avg(y) FILTER (WHERE y > 0) AS m, avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM train GROUP BY 1"
_TSB = """list_reduce(list_prepend({{'p': {p0}, 'd': {d0}, 'y': 0.0::DOUBLE}}, list_transform(v, lambda x: {{'p': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'y': x}})),
    lambda a, x: {{'p': {ap}::DOUBLE * (CASE WHEN x.y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + {bp}::DOUBLE * a.p, 'd': CASE WHEN x.y > 0 THEN {ad}::DOUBLE * x.y + {bd}::DOUBLE * a.d ELSE a.d END, 'y': 0.0::DOUBLE}})"""


@query(
    f"""SELECT sku, round(least(greatest(s.p * s.d, 0), cap), 4) AS pred FROM (SELECT sku, {_TSB.format(p0='CASE WHEN v[1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', d0='pos[1]', ap=0.1, bp=0.9, ad=0.2, bd=0.8)} AS s FROM ({_SERIES}))
    JOIN ({_CAP.format(q=0.95)}) USING (sku)""",
    "train",
)
def tsb_c0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.tsb_first(split(spark, sf_dir)[0]), 4)


@query(f"SELECT sku, round(greatest(s.p * s.d, 0), 4) AS pred FROM (SELECT sku, {_TSB.format(p0='least(greatest(r, 1e-6::DOUBLE), 1.0::DOUBLE)', d0='m', ap=0.1, bp=0.9, ad=0.2, bd=0.8)} AS s FROM ({_SERIES}))", "train")
def tsb_c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.tsb_mean(split(spark, sf_dir)[0]), 4)


_ADIDA = "SELECT sku, {k} AS k, greatest(avg(s) / {k}, 0) AS pred FROM (SELECT sku, (rn - 1) // {k} AS b, sum(y) AS s FROM (" + _LAST + ") GROUP BY 1, 2) WHERE b < 4 GROUP BY 1"


@query(f"SELECT sku, round(pred, 6) AS pred FROM ({_ADIDA.format(k=7)})", "train")
def adida(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.adida(split(spark, sf_dir)[0]))


@query(f"SELECT sku, round(sum(pred) / 3, 6) AS pred FROM ({' UNION ALL '.join(_ADIDA.format(k=k) for k in (7, 14, 28))}) GROUP BY 1", "train")
def imapa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.imapa(split(spark, sf_dir)[0]))


@query(
    f"""WITH l AS (SELECT * FROM ({_LAST}) WHERE rn <= 56), g AS (SELECT sku, avg(y) FILTER (WHERE rn <= 28) AS g FROM l GROUP BY 1), d AS (SELECT sku, isodow(date) AS wd, avg(y) AS m FROM l GROUP BY 1, 2)
    SELECT t.sku, t.date, t.y, round(least(greatest(0.7::DOUBLE * m + 0.3::DOUBLE * g, 0), cap), 6) AS pred FROM test t JOIN g USING (sku) JOIN d ON d.sku = t.sku AND d.wd = isodow(t.date) JOIN ({_CAP.format(q=0.90)}) c ON c.sku = t.sku""",
    "train test",
)
def weekday_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.weekday_means(*split(spark, sf_dir)).withColumn("pred", F.round("pred", 6))


@query("SELECT sku, CASE WHEN count(*) < 28 THEN 'fallback_short' WHEN count(*) FILTER (WHERE y > 0) < 6 OR count(*) FILTER (WHERE y > 0) / count(*) < 0.05 THEN 'fallback_sparse' ELSE 'tsb' END AS model FROM train GROUP BY 1", "train")
def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.route(split(spark, sf_dir)[0])


@query(
    f"""SELECT w.sku, w.date, w.y, r.model, round(CASE WHEN r.model = 'tsb' THEN c.pred ELSE w.pred END, 4) AS pred
    FROM ({ORACLES['weekday_fallback']}) w JOIN ({ORACLES['router']}) r USING (sku) JOIN ({ORACLES['tsb_c0']}) c USING (sku)"""
)
def routed_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.routed(*split(spark, sf_dir)).withColumn("pred", F.round("pred", 4))


@query(
    f"""SELECT sku, 'sma28' AS method, round(greatest(avg(y), 0), 6) AS pred FROM ({_LAST}) WHERE rn <= 28 GROUP BY 1
    UNION ALL SELECT sku, 'adida', round(pred, 6) FROM ({_ADIDA.format(k=7)}) UNION ALL SELECT sku, 'imapa', round(sum(pred) / 3, 6) FROM ({' UNION ALL '.join(_ADIDA.format(k=k) for k in (7, 14, 28))}) GROUP BY 1
    UNION ALL SELECT sku, 'tsb', round(greatest(s.p * s.d, 0), 6) FROM (SELECT sku, {_TSB.format(p0='least(greatest(r, 1e-6::DOUBLE), 1.0::DOUBLE)', d0='m', ap=0.1, bp=0.9, ad=0.2, bd=0.8)} AS s FROM ({_SERIES}))""",
    "train",
)
def baseline_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.baselines(split(spark, sf_dir)[0]), 6)


@query()
def smoothing_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which model of the smoothing family each series' own last days choose, its parameters and squared errors, fitted on all days."""
    return M.chosen(split(spark, sf_dir)[0], TEST_DAYS).drop("forecast")


@query()
def smoothing_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, squared error and residual variance of simple smoothing and of additive trend and season, of every series of raw demand."""
    return M.parameters(dense(spark, sf_dir), [M.Model(log=False), M.Model("add", "add", log=False)])


@query()
def seasonal_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.smoothing(split(spark, sf_dir)[0], TEST_DAYS)


@query(
    """WITH a AS (SELECT quantile_cont(y, 0.05) FILTER (WHERE y > 0) AS all_tau FROM train),
    o AS (SELECT sku, quantile_cont(y, 0.05) FILTER (WHERE y > 0) AS tau, avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM train GROUP BY 1)
    SELECT sku, round(coalesce(tau, all_tau), 4) AS tau, round(least(greatest(0.6::DOUBLE - 0.4::DOUBLE * rate, 0.15), 0.6), 6) AS scale, round(coalesce(tau, all_tau) * least(greatest(0.6::DOUBLE - 0.4::DOUBLE * rate, 0.15), 0.6), 4) AS threshold FROM o, a""",
    "train",
)
def sku_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.sku_tau(split(spark, sf_dir)[0]).select("sku", F.round("tau", 4).alias("tau"), F.round("scale", 6).alias("scale"), F.round("threshold", 4).alias("threshold"))


@query(
    """SELECT sku, date, round(least(greatest(sqrt(y / m + 1) * (CASE WHEN y >= a THEN 1.5 ELSE 1.0 END) * (CASE WHEN y >= b THEN 2.0 ELSE 1.0 END), 1), 8), 6) AS weight
    FROM (SELECT * FROM train WHERE y > 0), (SELECT greatest(median(y), 1) AS m, quantile_cont(y, 0.9) AS a, quantile_cont(y, 0.98) AS b FROM train WHERE y > 0)""",
    "train",
)
def tail_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(post.positive_weights(split(spark, sf_dir)[0].where("y > 0")).select("sku", "date", "weight"))


@query(
    """SELECT sku, p, size, round(CASE WHEN p < 0.25 THEN 0 ELSE least(greatest(0.9::DOUBLE * (p * size), 0), (SELECT quantile_cont(y, 0.98) FROM train WHERE y > 0)) END, 4) AS pred
    FROM (SELECT sku, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS p, round(avg(y) FILTER (WHERE y > 0), 4) AS size FROM train GROUP BY 1)""",
    "train",
)
def two_stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split(spark, sf_dir)[0]
    rows = train.groupBy("sku").agg(F.round(F.avg((F.col("y") > 0).cast("double")), 6).alias("p"), F.round(F.avg(F.when(F.col("y") > 0, F.col("y"))), 4).alias("size"))
    gated = rows.crossJoin(F.broadcast(post.global_cap(train, 0.98)))  # one row
    return gated.select("sku", "p", "size", F.round(post.two_stage(F.col("p"), F.col("size"), cap=F.col("cap")), 4).alias("pred"))


@query("SELECT 200.0::DOUBLE AS cap_low, least(greatest(ceil(quantile_cont(n, 0.995)), 200), 300) AS cap_mid, least(greatest(ceil(quantile_cont(n, 0.999)), least(greatest(ceil(quantile_cont(n, 0.995)), 200), 300), 200), 400) AS cap_high FROM (SELECT y / 100 AS n FROM train WHERE y > 0)", "train")
def candidate_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.candidate_caps(split(spark, sf_dir)[0].withColumn("y", F.col("y") / 100))


@query("SELECT sku, date, CAST(least(round_even(greatest(y / 100, 0), 0), 200) AS DOUBLE) AS n FROM train", "train")
def count_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir)[0].select("sku", "date", post.count_target(F.col("y") / 100, F.lit(200.0)).alias("n"))


@query("SELECT sku, string_agg(CAST(CAST(round(y * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY date) AS cents, CAST(count(*) AS INTEGER) AS n FROM train GROUP BY 1", "train")
def forecast_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series as one ordered array, told in hundredths, with its length."""
    cents = F.transform("values", lambda y: F.round(y * 100).cast("long").cast("string"))
    return P.series(split(spark, sf_dir)[0]).select("sku", F.array_join(cents, ",").alias("cents"), F.size("values").alias("n"))
