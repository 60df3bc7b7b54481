"""Panels, calendars and history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import calendar
from tallyloom.operators import history as H
from tallyloom.operators import panel as P
from tallyloom.plans.registry import query
from tallyloom.sources.retail import retail_tx

TEST_DAYS = 56


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_sum(retail_tx(spark, sf_dir), "description")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zero_panel(daily(spark, sf_dir))


def split(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test panel: the last 56 days are the test. sums: the daily sums, where they are written already."""
    panel = dense(spark, sf_dir) if sums is None else P.zero_panel(sums)
    last = F.broadcast(panel.agg(F.date_sub(F.max("date"), TEST_DAYS - 1).alias("test_start")))  # one row
    marked = panel.crossJoin(last)
    return marked.where("date < test_start").drop("test_start"), marked.where("date >= test_start").drop("test_start")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse regime: brand and size as key."""
    return P.daily_sum(retail_tx(spark, sf_dir), "line")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("SELECT * FROM panel", "panel")
def zero_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir)


@query(
    """SELECT s.sku, d.date, coalesce(y, 0.0) AS y FROM (SELECT sku FROM daily WHERE date < DATE '1998-01-01' UNION SELECT sku FROM daily WHERE date >= DATE '1998-01-01') s
    CROSS JOIN spine d LEFT JOIN daily USING (sku, date)""",
    "daily spine",
)
def zero_panel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir)
    half, other = rows.where("date < '1998-01-01'"), rows.where("date >= '1998-01-01'")
    return P.zero_panel(rows, half.select("sku").union(other.select("sku")), rows)


@query(
    """SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(day(date) AS INTEGER) AS day, CAST(week(date) AS INTEGER) AS week, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
    CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start, CAST(date = last_day(date) AS INTEGER) AS is_month_end,
    CAST(date = date_trunc('quarter', date) AS INTEGER) AS is_quarter_start, CAST(date = last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS INTEGER) AS is_quarter_end,
    CAST(quarter(date) = 4 AS INTEGER) AS is_q4, CAST(day(date) <= 5 AS INTEGER) AS is_early_month, CAST(month(date) IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end_month,
    CAST(month(date) >= 11 AS INTEGER) AS is_peak_month, CAST(week(date) >= 50 AS INTEGER) AS is_last_weeks,
    round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) AS dow_cos,
    round(sin(2 * pi() * week(date) / 52), 6) AS week_sin, round(cos(2 * pi() * week(date) / 52), 6) AS week_cos FROM spine""",
    "spine",
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.spine(daily(spark, sf_dir)).withColumns(calendar.features(F.col("date"))))


@query(
    """SELECT sku, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero_rate, round(avg(CASE WHEN y <= 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate,
    round(coalesce(avg(y) FILTER (WHERE y > 0), 0), 6) AS pos_mean, round(coalesce(median(y) FILTER (WHERE y > 0), 0), 6) AS pos_median,
    round(coalesce(count(*) / nullif(count(*) FILTER (WHERE y > 0), 0), count(*)), 6) AS adi,
    round(coalesce(pow(stddev_pop(y) FILTER (WHERE y > 0) / avg(y) FILTER (WHERE y > 0), 2), 0), 6) AS cv2,
    round(coalesce((max(t) FILTER (WHERE y > 0) - min(t) FILTER (WHERE y > 0)) / nullif(count(*) FILTER (WHERE y > 0) - 1, 0), count(*)), 6) AS mean_gap,
    coalesce(max_by(y, date) FILTER (WHERE y > 0), 0) AS last_nonzero, max(date) FILTER (WHERE y > 0) AS last_sale,
    max(y) FILTER (WHERE rn = 1) AS last_1, coalesce(max(y) FILTER (WHERE rn = 7), 0) AS last_7, round(avg(y) FILTER (WHERE rn <= 7), 6) AS recent_7, round(avg(y) FILTER (WHERE rn <= 28), 6) AS recent_28
    FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS rn, row_number() OVER (PARTITION BY sku ORDER BY date) AS t FROM train) GROUP BY 1""",
    "train",
)
def sku_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.profile(split(spark, sf_dir)[0]).drop("total"), 6)


_W = "OVER (PARTITION BY sku ORDER BY date"


@query(
    f"""SELECT sku, date, {', '.join(f'coalesce(lag(y, {k}) {_W}), 0) AS lag_{k}, coalesce(lag(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END, {k}) {_W}), 0) AS lag_is_sale_{k}' for k in (1, 7, 14, 28))} FROM panel""",
    "panel",
)
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.lagged(dense(spark, sf_dir), windows=())
    return out.select("sku", "date", *[c for k in (1, 7, 14, 28) for c in (f"lag_{k}", f"lag_is_sale_{k}")])


@query(
    f"""SELECT sku, date, {', '.join(f'round(coalesce(avg(y) {_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0), 6) AS roll_mean_{w}, round(coalesce(stddev_pop(y) {_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0), 6) AS roll_std_{w}' for w in (7, 14, 28))} FROM panel""",
    "panel",
)
def rolling_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.lagged(dense(spark, sf_dir), lags=())
    return out.select("sku", "date", *[F.round(f"roll_{s}_{w}", 6).alias(f"roll_{s}_{w}") for w in (7, 14, 28) for s in ("mean", "std")])


@query(f"SELECT sku, date, {', '.join(f'round(coalesce(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) {_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0), 6) AS sale_rate_{w}' for w in (7, 28, 56))} FROM panel", "panel")
def sale_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.lagged(dense(spark, sf_dir), lags=(), windows=(7, 28, 56))
    return out.select("sku", "date", *[F.round(f"sale_rate_{w}", 6).alias(f"sale_rate_{w}") for w in (7, 28, 56)])


@query(
    f"""SELECT sku, date, {', '.join(f'round(avg(p) {_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS roll_mean_{w}, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) {_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS sale_rate_{w}' for w in (7, 28))},
    CAST(coalesce(t - 1 - max(CASE WHEN y > 0 THEN t END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS INTEGER) AS rows_since_sale, round(ln(1 + p), 6) AS log_lag_1
    FROM (SELECT *, greatest(coalesce(lag(y, 1) {_W}), 0), 0) AS p, row_number() {_W}) AS t FROM panel)""",
    "panel",
)
def rolling_c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.zero_led(dense(spark, sf_dir)).drop("y")
    return out.select("sku", "date", *[F.round(c, 6).alias(c) if c != "rows_since_sale" else F.col(c) for c in out.columns[2:]])


@query(
    f"""SELECT sku, date, CAST(coalesce(date - max(CASE WHEN y > 0 THEN date END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS INTEGER) AS days_since_sale,
    CAST(least(56, coalesce(date - max(CASE WHEN y > 0 THEN date END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999)) AS INTEGER) AS days_clipped FROM panel""",
    "panel",
)
def days_since_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    return dense(spark, sf_dir).select("sku", "date", H.days_since_sale(y).alias("days_since_sale"), H.days_since_sale(y, 56).alias("days_clipped"))


@query(
    f"""SELECT sku, date, round(coalesce(lag(list_reduce(h, lambda a, x: a * 0.75::DOUBLE + x * 0.25::DOUBLE), 1) {_W}), 0), 6) AS ewm_mean_7 FROM (
        SELECT sku, date, list(y) {_W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS h FROM panel)""",
    "panel",
)
def ewm_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole panel. The oracle begins 199 days before each: what comes before those has a weight below 1e-24."""
    out = H.ewm(dense(spark, sf_dir), {"ewm_mean_7": (lambda y: y, 7)})
    return out.select("sku", "date", F.round("ewm_mean_7", 6).alias("ewm_mean_7"))


def _mean(value: str, span: int, days: int) -> str:
    """SQL for the weighted mean up to a day: what lies further back than `days` has a weight below 1e-12."""
    a = f"(2::DOUBLE / {span + 1})"
    return f"list_reduce(list({value}) {_W} ROWS BETWEEN {days} PRECEDING AND CURRENT ROW), lambda a, x: a * (1 - {a}) + x * {a})"


@query(
    f"""WITH pos AS (SELECT sku, date, y, pow(13::DOUBLE / 15, date - lag(date) {_W})) AS old FROM panel WHERE y > 0),
    e AS (SELECT sku, date, (list_reduce(list({{'x': y, 'c': coalesce(old / (old + 2::DOUBLE / 15), 0)}}) {_W} ROWS BETWEEN 299 PRECEDING AND CURRENT ROW), lambda a, s: {{'x': s.c * a.x + (1 - s.c) * s.x, 'c': 0::DOUBLE}})).x AS e FROM pos),
    m AS (SELECT panel.sku, panel.date, {_mean('panel.y', 7, 199).replace('OVER (PARTITION BY sku ORDER BY date', 'OVER (PARTITION BY panel.sku ORDER BY panel.date')} AS a, {_mean('panel.y', 28, 449).replace('OVER (PARTITION BY sku ORDER BY date', 'OVER (PARTITION BY panel.sku ORDER BY panel.date')} AS b,
        {_mean('CASE WHEN panel.y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 14, 249).replace('OVER (PARTITION BY sku ORDER BY date', 'OVER (PARTITION BY panel.sku ORDER BY panel.date')} AS p,
        last_value(e IGNORE NULLS) OVER (PARTITION BY panel.sku ORDER BY panel.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM panel LEFT JOIN e ON e.sku = panel.sku AND e.date = panel.date)
    SELECT sku, date, round(coalesce(lag(a) {_W}), 0), 6) AS ewm_mean_7, round(coalesce(lag(b) {_W}), 0), 6) AS ewm_mean_28, round(coalesce(lag(p) {_W}), 0), 6) AS ewm_sale_prob_14, round(coalesce(lag(q) {_W}), 0), 6) AS ewm_pos_mean_14 FROM m""",
    "panel",
)
def ewm_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, sale probabilities and means of positive days alone, whose gaps count as time."""
    specs = {"ewm_mean_7": (lambda y: y, 7), "ewm_mean_28": (lambda y: y, 28), "ewm_sale_prob_14": (lambda y: (y > 0).cast("double"), 14), "ewm_pos_mean_14": (lambda y: F.when(y > 0, y), 14)}
    return rounded(H.ewm(dense(spark, sf_dir), specs).drop("y"), 6)


_P = ", ".join(f"round({last} * pow({b}, h) + mean * (1 - pow({b}, h)), 4) AS proxy_{n}" for n, last, b in (("lag_1", "last_1", 0.75), ("lag_7", "last_7", 0.88), ("roll_7", "recent_7", 0.9), ("roll_28", "recent_28", 0.96)))


@query(
    f"""SELECT sku, date, CAST(h AS INTEGER) AS h, {_P} FROM (SELECT sku, date, row_number() {_W}) AS h FROM test)
    JOIN (SELECT sku, avg(y) AS mean, max(y) FILTER (WHERE rn = 1) AS last_1, max(y) FILTER (WHERE rn = 7) AS last_7, avg(y) FILTER (WHERE rn <= 7) AS recent_7, avg(y) FILTER (WHERE rn <= 28) AS recent_28
        FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS rn FROM train) GROUP BY 1) USING (sku)""",
    "train test",
)
def proxy_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    return rounded(H.proxies(test, H.profile(train)), 4)


_O = ", ".join(f"round({n} * pow({b}, h) + prior * (1 - pow({b}, h)), 6) AS occ_{n}" for n, b in H.OCCURRENCE_BETA.items())
_EWM = ", ".join(f"sum(o * CASE WHEN rn = n THEN pow({k}::DOUBLE, rn - 1) ELSE {1 - k}::DOUBLE * pow({k}::DOUBLE, rn - 1) END) AS ewm_{s}" for s, k in ((7, 0.75), (28, 1 - 2 / 29)))


@query(
    f"""SELECT sku, date, CAST(h AS INTEGER) AS h, {_O} FROM (SELECT sku, date, row_number() {_W}) AS h FROM test)
    JOIN (SELECT sku, avg(o) AS prior, max(o) FILTER (WHERE rn = 1) AS lag_1, max(o) FILTER (WHERE rn = 7) AS lag_7, avg(o) FILTER (WHERE rn <= 7) AS roll_7, avg(o) FILTER (WHERE rn <= 14) AS roll_14, avg(o) FILTER (WHERE rn <= 28) AS roll_28, {_EWM}
        FROM (SELECT *, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY sku) AS n FROM train) GROUP BY 1) USING (sku)""",
    "train test",
)
def occurrence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    return rounded(H.occurrence_proxies(test, train), 6)


@query("SELECT sku, CAST(last + h AS DATE) AS date, 0.0::DOUBLE AS y FROM (SELECT DISTINCT sku FROM daily) CROSS JOIN (SELECT max(date) AS last FROM daily) CROSS JOIN (SELECT CAST(unnest(range(1, 91)) AS INTEGER) AS h)", "daily")
def future_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.future_grid(daily(spark, sf_dir), 90)


@query(
    """SELECT split, CAST(count(*) AS BIGINT) AS n_rows, round(avg(lag_1), 4) AS lag_1, round(avg(CASE WHEN since = 999 THEN 1.0 ELSE 0.0 END), 6) AS never_share FROM (
        SELECT *, coalesce(lag(y, 1) OVER (PARTITION BY sku ORDER BY date), 0) AS lag_1, coalesce(date - max(CASE WHEN y > 0 THEN date END) OVER (PARTITION BY sku ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS since
        FROM (SELECT *, 'train' AS split FROM train UNION ALL SELECT *, 'test' FROM test)) GROUP BY 1""",
    "train test",
)
def diagnostic_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    y = F.col("y")
    rows = both.select("split", H.lag(y, 1).alias("lag_1"), H.days_since_sale(y).alias("since"))
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.avg("lag_1"), 4).alias("lag_1"), F.round(F.avg((F.col("since") == H.NEVER).cast("double")), 6).alias("never_share"))


@query("SELECT date, round(1.0 + (r - 1) / greatest(1, n - 1), 6) AS weight, CAST(count(*) AS BIGINT) AS n_rows FROM train JOIN (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM train)) USING (date) GROUP BY ALL", "train")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = H.recency_weight(split(spark, sf_dir)[0])
    return weighted.groupBy("date", F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n_rows"))


@query("SELECT CAST(sum(CASE WHEN date > c THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, CAST(count(*) AS BIGINT) AS n_rows FROM panel, (SELECT max(date) AS c FROM (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM spine) WHERE r <= floor(n * 0.8))", "panel spine")
def split_by_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fraction_split(dense(spark, sf_dir)).agg(F.count_if("is_valid").alias("n_valid"), F.count("*").alias("n_rows"))


@query(
    """SELECT sku, CAST(n AS BIGINT) AS n, CAST(CASE WHEN n < 56 THEN 0 ELSE greatest(14, least(42, n // 3)) END AS BIGINT) AS n_clamped, CAST(CASE WHEN n <= 56 THEN least(n, greatest(7, n // 5)) ELSE 42 END AS BIGINT) AS n_shrunk
    FROM (SELECT stock_code AS sku, count(DISTINCT date) AS n FROM tx GROUP BY 1)""",
    "tx",
)
def holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days each product's own series keeps for validation, by two rules."""
    rows = retail_tx(spark, sf_dir).select(F.col("stock_code").alias("sku"), "date").distinct()
    flagged = P.holdout(P.holdout(rows, P.clamped_holdout, "clamped"), P.shrinking_holdout, "shrunk")
    return flagged.groupBy("sku").agg(F.count("*").alias("n"), F.count_if("clamped").alias("n_clamped"), F.count_if("shrunk").alias("n_shrunk"))
