"""Series statistics, segments and cluster comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import decomposition as D
from tallyloom.operators import panel as P
from tallyloom.operators import segment as G
from tallyloom.operators import stats as S
from tallyloom.plans.panels import dense, lines, rounded
from tallyloom.plans.registry import query
from tallyloom.sources.retail import retail_tx, table


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zero_panel(lines(spark, sf_dir))


_T = "SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date) AS t FROM line_panel"
_INTER = f"""SELECT sku, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE y > 0) AS BIGINT) AS n_pos,
    CASE WHEN count(*) FILTER (WHERE y > 0) > 1 THEN (max(t) FILTER (WHERE y > 0) - min(t) FILTER (WHERE y > 0)) / (count(*) FILTER (WHERE y > 0) - 1) ELSE count(*) END AS adi,
    CASE WHEN count(*) FILTER (WHERE y > 0) > 1 THEN pow(stddev_pop(y) FILTER (WHERE y > 0) / avg(y) FILTER (WHERE y > 0), 2) END AS cv2, avg(y) FILTER (WHERE y > 0) AS demand FROM ({_T}) GROUP BY 1"""


@query(f"SELECT sku, n, n_pos, round(adi, 6) AS adi, round(cv2, 6) AS cv2 FROM ({_INTER})", "line_panel")
def intermittency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.intermittency(sparse(spark, sf_dir)))


@query(
    f"""SELECT sku, CASE WHEN n_pos > 0 THEN round(demand, 8) END AS demand, CASE WHEN n_pos > 0 THEN round(adi, 6) END AS interval, round(CASE WHEN n_pos > 0 THEN demand / adi ELSE 0 END, 6) AS croston,
    round(n_pos / n, 6) AS probability, round(CASE WHEN n_pos > 0 THEN n_pos / n * demand ELSE 0 END, 6) AS tsb FROM ({_INTER})""",
    "line_panel",
)
def croston_tsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.demand_summary(sparse(spark, sf_dir))
    return out.select("sku", *[F.round(c, 8 if c == "demand" else 6).alias(c) for c in out.columns[1:]])


_ACF = ", ".join(f"round(coalesce(CASE WHEN stddev_pop(y) FILTER (WHERE l{k} IS NOT NULL) = 0 OR stddev_pop(l{k}) = 0 THEN 0 ELSE corr(y, l{k}) END, 0), 6) AS acf_{k}" for k in (1, 7, 14, 30))


@query(f"SELECT sku, {_ACF} FROM (SELECT *, {', '.join(f'lag(y, {k}) OVER (PARTITION BY sku ORDER BY date) AS l{k}' for k in (1, 7, 14, 30))} FROM panel) GROUP BY 1", "panel")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.autocorrelation(dense(spark, sf_dir)))


@query(
    """SELECT sku, round(regr_slope(m, t), 6) AS slope, round(max_by(m, t) - min_by(m, t), 6) AS growth FROM (
        SELECT sku, CAST(row_number() OVER (PARTITION BY sku ORDER BY date) - 1 AS DOUBLE) AS t,
        CASE WHEN count(*) OVER w >= 3 THEN avg(y) OVER w ELSE 0 END AS m FROM panel WINDOW w AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) GROUP BY 1""",
    "panel",
)
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.trend(dense(spark, sf_dir)))


@query(
    """SELECT sku, round(avg(r), 6) AS roll_ratio FROM (SELECT sku, CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(y) OVER w / nullif(avg(y) OVER w, 0) END AS r
    FROM (SELECT sku, date, greatest(y, 0) AS y FROM panel) WINDOW w AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) GROUP BY 1""",
    "panel",
)
def roll_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of clipped demand: over returns a mean near 0 makes the ratio a matter of rounding."""
    return rounded(S.roll_ratio(dense(spark, sf_dir).withColumn("y", F.greatest("y", F.lit(0.0)))))


@query("SELECT sku, round(coalesce(max(p), 0), 6) AS peak_size, CAST(count(*) FILTER (WHERE y >= p) AS BIGINT) AS peak_days FROM panel LEFT JOIN (SELECT sku, quantile_cont(y, 0.95) AS p FROM panel WHERE y > 0 GROUP BY 1) USING (sku) GROUP BY 1", "panel")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.peaks(dense(spark, sf_dir)))


@query(
    f"""SELECT sku, CAST(coalesce(max(n) FILTER (WHERE zero), 0) AS BIGINT) AS longest_zero_streak FROM (SELECT sku, zero, island, count(*) AS n FROM (
        SELECT sku, y = 0 AS zero, t - row_number() OVER (PARTITION BY sku, y = 0 ORDER BY date) AS island FROM ({_T})) GROUP BY ALL) GROUP BY 1""",
    "line_panel",
)
def zero_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.longest_zero_run(sparse(spark, sf_dir)).select("sku", F.col("longest_zero_streak").cast("long").alias("longest_zero_streak"))


@query(
    f"""SELECT sku, round(sum(y), 2) AS total_sales, round(avg(y), 6) AS mean_daily, round(coalesce(stddev_pop(y) / nullif(avg(y), 0), 0), 6) AS cv, round(avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero_rate,
    round(avg(CASE WHEN y < 0 THEN 1.0 ELSE 0.0 END), 6) AS neg_day_rate, round(CASE WHEN count(*) FILTER (WHERE y <> 0) > 1 THEN (max(t) FILTER (WHERE y <> 0) - min(t) FILTER (WHERE y <> 0)) / (count(*) FILTER (WHERE y <> 0) - 1) ELSE count(*) END, 6) AS avg_gap
    FROM ({_T.replace('line_panel', 'panel')}) GROUP BY 1""",
    "panel",
)
def level_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.level(dense(spark, sf_dir))).withColumn("total_sales", F.round("total_sales", 2))


@query("SELECT sku, round(regr_slope(y, l), 6) AS phi FROM (SELECT sku, y, lag(y) OVER (PARTITION BY sku ORDER BY date) AS l FROM panel) WHERE l IS NOT NULL GROUP BY 1", "panel")
def ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ar1(dense(spark, sf_dir)).select("sku", F.round("phi", 6).alias("phi"))


_WEEKS = """w AS (SELECT sku, CAST(date + CAST((7 - dayofweek(date)) % 7 AS INTEGER) AS DATE) AS week, round(sum(y), 2) AS y FROM lines GROUP BY 1, 2),
    g AS (SELECT sku, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w GROUP BY 1),
    weekly AS (SELECT sku, week, coalesce(y, 0.0) AS y FROM g LEFT JOIN w USING (sku, week)),
    stats AS (SELECT sku, CAST(count(*) AS BIGINT) AS weeks, CAST(count(*) FILTER (WHERE y > 0) AS BIGINT) AS nonzero_weeks, CASE WHEN count(*) FILTER (WHERE y > 0) > 0 THEN count(*) / count(*) FILTER (WHERE y > 0) ELSE 'inf'::DOUBLE END AS adi,
        CASE WHEN count(*) FILTER (WHERE y > 0) > 1 THEN pow(stddev_samp(y) FILTER (WHERE y > 0) / avg(y) FILTER (WHERE y > 0), 2) WHEN count(*) FILTER (WHERE y > 0) = 1 THEN 0 END AS cv2,
        CASE WHEN count(*) FILTER (WHERE y > 0) >= 4 THEN quantile_cont(y, 0.95) / (median(y) FILTER (WHERE y > 0) + 1e-6) END AS spike_score FROM weekly GROUP BY 1),
    labelled AS (SELECT *, CASE WHEN adi <= 1.32 THEN 'regular' WHEN coalesce(cv2 <= 0.49, false) THEN 'intermittent' ELSE 'lumpy' END AS segment,
        coalesce(cv2 > 0.49, false) AND adi <= 1.32 AS erratic_flag, coalesce(spike_score >= 5, false) AS spike_flag FROM stats)"""


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.weekly_panel(lines(spark, sf_dir))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weekly(spark, sf_dir)
    joined = S.weekly_intermittency(rows).join(S.spikes(rows), "sku")
    adi, cv2, spike = F.col("adi"), F.col("cv2"), F.col("spike_score")
    return joined.withColumns({"segment": G.segment3(adi, cv2)} | G.flags(adi, cv2, spike))


@query(f"WITH {_WEEKS} SELECT sku, weeks, nonzero_weeks, round(adi, 6) AS adi, round(cv2, 6) AS cv2 FROM stats WHERE nonzero_weeks > 0", "lines")
def adi_cv2_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.weekly_intermittency(weekly(spark, sf_dir)).where("nonzero_weeks > 0"))


@query(f"WITH {_WEEKS} SELECT sku, round(spike_score, 6) AS spike_score FROM stats", "lines")
def spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.spikes(weekly(spark, sf_dir)))


@query(f"WITH {_WEEKS} SELECT sku, segment, erratic_flag, spike_flag FROM labelled", "lines")
def segment3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark, sf_dir).select("sku", "segment", "erratic_flag", "spike_flag")


@query(f"WITH {_WEEKS} SELECT segment, CAST(count(*) AS BIGINT) AS n, round(median(adi), 6) AS adi_median, round(median(cv2), 6) AS cv2_median, round(avg(CAST(erratic_flag AS INTEGER)), 6) AS erratic_rate, round(avg(CAST(spike_flag AS INTEGER)), 6) AS spike_rate FROM labelled GROUP BY 1", "lines")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.summary(segmented(spark, sf_dir)))


@query(
    f"WITH {_WEEKS}"
    + " UNION ALL ".join(
        f" SELECT segment, '{c}' AS feature, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(avg({c}) - median({c}), 4) AS shift, round((avg({c}) - median({c})) / nullif(median({c}), 0), 4) AS relative_shift FROM labelled GROUP BY 1"
        for c in ("nonzero_weeks", "cv2")
    ),
    "lines",
)
def profiles_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.shifted_profiles(segmented(spark, sf_dir).withColumn("nonzero_weeks", F.col("nonzero_weeks").cast("double")), "segment", ["nonzero_weeks", "cv2"]), 4)


@query(f"WITH {_WEEKS} SELECT segment, total, round(total / sum(total) OVER (), 6) AS share, n FROM (SELECT segment, round(sum(y), 2) AS total, CAST(count(DISTINCT sku) AS BIGINT) AS n FROM lines JOIN labelled USING (sku) GROUP BY 1)", "lines")
def cluster_sales_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lines(spark, sf_dir).join(segmented(spark, sf_dir).select("sku", "segment"), "sku")
    totals = joined.groupBy("segment").agg(F.round(F.sum("y"), 2).alias("total"), F.count_distinct("sku").alias("n"))
    return totals.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


@query(
    """WITH l AS (SELECT p_size % 4 AS a, p_partkey % 3 AS b FROM part), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS c, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS b, (SELECT count(*) FROM l) AS t)
    SELECT round((c - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM s"""
)
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("a"), (F.col("p_partkey") % 3).alias("b"))
    return rounded(G.rand_index(parts, "a", "b"))


@query("SELECT p_type AS label, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS rank FROM part GROUP BY 1")
def size_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.size_rank(table(spark, sf_dir, "part"), "p_type"))


@query(
    """WITH f AS (SELECT p_partkey AS part, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part)
    SELECT part, round((size - (SELECT avg(size) FROM f)) / (SELECT stddev_pop(size) FROM f), 6) AS size, round((price - (SELECT avg(price) FROM f)) / (SELECT stddev_pop(price) FROM f), 6) AS price FROM f"""
)
def standardized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rounded(G.standardized(parts, ["size", "price"]))


@query()
def series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum, partial autocorrelation, seasonal strength and tests of every series."""
    return S.numeric_features(dense(spark, sf_dir))


@query()
def stl_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season, trend and rest of every series of the weekly pattern, with the weights that peaks were given."""
    return D.components(dense(spark, sf_dir), 7)


@query()
def weekly_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of the yearly season of weekly demand, and the flag at 0.30."""
    rows = S.weekly_strength(weekly(spark, sf_dir))
    return rows.withColumn("seasonal_flag", F.col("seasonal_strength") >= 0.30)


@query()
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series: all statistics side by side, undefined ones as 0."""
    panel = dense(spark, sf_dir)
    out = S.level(panel)
    for part in (S.intermittency(panel).select("sku", "adi", "cv2"), S.autocorrelation(panel), S.trend(panel), S.roll_ratio(panel), S.peaks(panel), S.longest_zero_run(panel)):
        out = out.join(part, "sku")
    tx = retail_tx(spark, sf_dir).groupBy(F.col("description").alias("sku")).agg(F.avg("price").alias("price_mean"), F.stddev_samp("price").alias("price_std"), F.count_distinct("customer_id").alias("unique_customers"))
    out = out.join(tx, "sku", "left")
    return out.select("sku", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in out.columns if c != "sku"])
