"""Aggregates, joins, rankings and reshaping over transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import panel, prep
from tallyloom.operators.ranking import running_totals
from tallyloom.plans.registry import query
from tallyloom.sources.retail import retail_tx, table
from tallyloom.sources.tables import first_per_key, upsert_columns


@query("SELECT * FROM daily", "daily")
def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.daily_sum(retail_tx(spark, sf_dir), "description")


@query(
    """WITH w AS (SELECT sku, CAST(date + CAST((7 - dayofweek(date)) % 7 AS INTEGER) AS DATE) AS week, round(sum(y), 2) AS y FROM daily GROUP BY 1, 2),
    g AS (SELECT sku, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w GROUP BY 1)
    SELECT sku, week, coalesce(y, 0.0) AS y FROM g LEFT JOIN w USING (sku, week)""",
    "daily",
)
def weekly_sunday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.weekly_panel(panel.daily_sum(retail_tx(spark, sf_dir), "description"))


@query(
    """WITH w AS (SELECT sku, CAST(date_trunc('week', date) AS DATE) AS period_start, round(sum(y), 2) AS total, round(avg(y), 6) AS mean FROM daily GROUP BY 1, 2),
    g AS (SELECT sku, CAST(unnest(generate_series(min(period_start), max(period_start), INTERVAL 7 DAY)) AS DATE) AS period_start FROM w GROUP BY 1)
    SELECT sku, period_start, coalesce(total, 0.0) AS total, mean FROM g LEFT JOIN w USING (sku, period_start)""",
    "daily",
)
def weekly_monday_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = panel.daily_sum(retail_tx(spark, sf_dir), "description")
    weeks = panel.gap_filled_weeks(daily, {"total": F.col("y")}, {"mean": F.col("y")})
    return weeks.select("sku", "period_start", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


@query("SELECT description, round(avg(basket), 4) AS avg_basket FROM (SELECT description, invoice, round(sum(sales_amount), 2) AS basket FROM tx GROUP BY 1, 2) GROUP BY 1", "tx")
def basket_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = retail_tx(spark, sf_dir).groupBy("description", "invoice").agg(F.round(F.sum("sales_amount"), 2).alias("basket"))
    return per.groupBy("description").agg(F.round(F.avg("basket"), 4).alias("avg_basket"))


@query(
    """SELECT description, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers,
    CAST(count(DISTINCT country) AS BIGINT) AS unique_countries FROM tx GROUP BY 1""",
    "tx",
)
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail_tx(spark, sf_dir).groupBy("description").agg(
        F.round(F.avg("price"), 4).alias("price_mean"), F.round(F.stddev_samp("price"), 4).alias("price_std"),
        F.count_distinct("customer_id").alias("unique_customers"), F.count_distinct("country").alias("unique_countries"),
    )


_TOTALS = "SELECT stock_code, round(sum(sales_amount), 2) AS total FROM tx GROUP BY 1"


@query(
    f"""SELECT stock_code, total, CAST(row_number() OVER (ORDER BY total DESC, stock_code) AS BIGINT) AS rank,
    round(sum(total) OVER (ORDER BY total DESC, stock_code ROWS UNBOUNDED PRECEDING) / sum(total) OVER (), 6) AS cumulative_share FROM ({_TOTALS})""",
    "tx",
)
def pareto_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Pareto curve of all codes."""
    totals = retail_tx(spark, sf_dir).groupBy("stock_code").agg(F.round(F.sum("sales_amount"), 2).alias("value"))
    ranked = running_totals(totals, [F.desc("value"), F.asc("stock_code")], "value")
    return ranked.select("stock_code", F.col("value").alias("total"), F.col("rank").cast("long").alias("rank"), F.round(F.col("running") / F.col("total"), 6).alias("cumulative_share"))


@query(f"SELECT stock_code, total FROM ({_TOTALS}) ORDER BY total DESC, stock_code LIMIT 50", "tx")
def topn_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = retail_tx(spark, sf_dir).groupBy("stock_code").agg(F.round(F.sum("sales_amount"), 2).alias("total"))
    return totals.orderBy(F.desc("total"), "stock_code").limit(50)


@query(
    """SELECT brand, stock_code, total, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY total DESC, stock_code) AS rn
    FROM (SELECT brand, stock_code, round(sum(sales_amount), 2) AS total FROM tx GROUP BY 1, 2)) WHERE rn <= 6""",
    "tx",
)
def topn_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = retail_tx(spark, sf_dir).groupBy("brand", "stock_code").agg(F.round(F.sum("sales_amount"), 2).alias("total"))
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("total"), "stock_code"))
    return totals.withColumn("rank", rank.cast("long")).where("rank <= 6")


@query("SELECT brand, total, round(total / sum(total) OVER (), 6) AS share FROM (SELECT brand, round(sum(sales_amount), 2) AS total FROM tx GROUP BY 1)", "tx")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = retail_tx(spark, sf_dir).groupBy("brand").agg(F.round(F.sum("sales_amount"), 2).alias("total"))
    return totals.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


@query("SELECT l_returnflag AS value, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(
    """SELECT sku, date, CASE WHEN date < DATE '1999-01-01' THEN y END AS y, CASE WHEN date < DATE '1999-01-01' THEN round(y * 2, 2) END AS pred_a, CASE WHEN date >= DATE '1998-01-01' THEN round(y * 3, 2) END AS pred_b FROM daily""",
    "daily",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = panel.daily_sum(retail_tx(spark, sf_dir), "description")
    old = daily.where("date < '1999-01-01'").select("sku", "date", "y", F.round(F.col("y") * 2, 2).alias("pred_a"), F.lit(1.0).alias("pred_b"))
    new = daily.where("date >= '1998-01-01'").select("sku", "date", F.round(F.col("y") * 3, 2).alias("pred_b"))
    return upsert_columns(old, new, ["sku", "date"])


@query("SELECT DISTINCT stock_code, description FROM tx WHERE stock_code NOT IN (SELECT DISTINCT stock_code FROM tx WHERE date < DATE '1995-06-01')", "tx")
def todo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = retail_tx(spark, sf_dir)
    done = tx.where("date < '1995-06-01'").select("stock_code").distinct()
    return tx.select("stock_code", "description").distinct().join(done, "stock_code", "left_anti")


@query(
    """SELECT description, list(stock_code ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY description ORDER BY c DESC, o, stock_code) AS rn
    FROM (SELECT description, stock_code, count(*) AS c, min(invoice) AS o FROM tx GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1""",
    "tx",
)
def modal_stock_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.top_values(retail_tx(spark, sf_dir), "description", "stock_code", "invoice")


@query("SELECT stock_code, invoice, sales_amount FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY date, invoice, sales_amount) AS rn FROM tx) WHERE rn = 1", "tx")
def first_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = retail_tx(spark, sf_dir).select("stock_code", "date", "invoice", "sales_amount")
    return first_per_key(tx, "stock_code", ["date", "invoice", "sales_amount"]).select("stock_code", "invoice", "sales_amount")


@query(
    """SELECT brand, round(coalesce(sum(sales_amount) FILTER (WHERE month(date) <= 3), 0), 2) AS Q1, round(coalesce(sum(sales_amount) FILTER (WHERE month(date) BETWEEN 4 AND 6), 0), 2) AS Q2,
    round(coalesce(sum(sales_amount) FILTER (WHERE month(date) BETWEEN 7 AND 9), 0), 2) AS Q3, round(coalesce(sum(sales_amount) FILTER (WHERE month(date) >= 10), 0), 2) AS Q4 FROM tx GROUP BY 1""",
    "tx",
)
def pivot_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = retail_tx(spark, sf_dir).withColumn("q", F.concat(F.lit("Q"), F.quarter("date").cast("string")))
    wide = tx.groupBy("brand").pivot("q", ["Q1", "Q2", "Q3", "Q4"]).agg(F.sum("sales_amount"))
    return wide.select("brand", *[F.round(F.coalesce(q, F.lit(0.0)), 2).alias(q) for q in ("Q1", "Q2", "Q3", "Q4")])


@query(
    """WITH w AS (SELECT brand, round(sum(quantity), 2) AS quantity, round(sum(sales_amount), 2) AS sales FROM tx GROUP BY 1)
    SELECT brand, 'quantity' AS measure, quantity AS value FROM w UNION ALL SELECT brand, 'sales', sales FROM w""",
    "tx",
)
def unpivot_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = retail_tx(spark, sf_dir).groupBy("brand").agg(F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.sum("sales_amount"), 2).alias("sales"))
    return wide.unpivot("brand", ["quantity", "sales"], "measure", "value")


@query(
    """SELECT 'both' AS part, stock_code FROM (SELECT stock_code FROM tx WHERE date < DATE '1996-01-01' INTERSECT SELECT stock_code FROM tx WHERE date >= DATE '2001-01-01')
    UNION ALL SELECT 'only_new', stock_code FROM (SELECT stock_code FROM tx WHERE date >= DATE '2001-01-01' EXCEPT SELECT stock_code FROM tx WHERE date < DATE '1996-01-01')""",
    "tx",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = retail_tx(spark, sf_dir)
    old, new = (tx.where(c).select("stock_code") for c in ("date < '1996-01-01'", "date >= '2001-01-01'"))
    return old.intersect(new).select(F.lit("both").alias("part"), "stock_code").unionByName(new.subtract(old).select(F.lit("only_new").alias("part"), "stock_code"))


@query(
    """SELECT coalesce(brand, 'all') AS brand, coalesce(CAST(year(date) AS VARCHAR), 'all') AS year, round(sum(sales_amount), 2) AS total, CAST(grouping(brand, year(date)) AS BIGINT) AS level
    FROM tx GROUP BY GROUPING SETS ((brand, year(date)), (brand), ())""",
    "tx",
)
def totals_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = retail_tx(spark, sf_dir).select("brand", F.year("date").alias("year"), "sales_amount")
    sets = tx.groupingSets([["brand", "year"], ["brand"], []], "brand", "year").agg(F.round(F.sum("sales_amount"), 2).alias("total"), F.grouping_id().alias("level"))
    return sets.select(F.coalesce("brand", F.lit("all")).alias("brand"), F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("year"), "total", "level")


@query("SELECT description, list(DISTINCT brand ORDER BY brand) AS brands, CAST(count(DISTINCT stock_code) AS BIGINT) AS n_codes FROM tx GROUP BY 1", "tx")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail_tx(spark, sf_dir).groupBy("description").agg(F.array_sort(F.collect_set("brand")).alias("brands"), F.count_distinct("stock_code").alias("n_codes"))


@query("SELECT brand, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.9), 4) AS p90, round(median(quantity), 4) AS median_quantity, round(avg(CASE WHEN quantity < 0 THEN 1.0 ELSE 0.0 END), 6) AS return_rate FROM tx GROUP BY 1", "tx")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail_tx(spark, sf_dir).groupBy("brand").agg(
        F.round(F.percentile("price", 0.5), 4).alias("p50"), F.round(F.percentile("price", 0.9), 4).alias("p90"), F.round(F.median("quantity"), 4).alias("median_quantity"),
        F.round(F.avg((F.col("quantity") < 0).cast("double")), 6).alias("return_rate"),
    )
