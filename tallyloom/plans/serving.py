"""Serving queries over baseline forecasts of the last days."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import normalize_text, product_key
from tallyloom.operators import learned as L
from tallyloom.operators import serving as V
from tallyloom.operators import univariate as U
from tallyloom.operators.panel import daily_sum, future_grid
from tallyloom.plans.panels import dense, split
from tallyloom.plans.registry import query
from tallyloom.session import fresh_path, materialize
from tallyloom.sources.retail import retail_tx, table

BUILT = "2024-01-01T00:00:00Z"
NAIVE = {1: ("naive7", "Weekly pattern", "pred", "p_sale")}
_NORM = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"
_KEY = f"'c1-' || replace(lower({_NORM.format('sku')}), ' ', '-') || '-' || md5({_NORM.format('sku')})[1:8]"
_IDS = """ids AS (SELECT description AS sku, arg_min(stock_code, rn) AS product_id FROM (SELECT description, stock_code, row_number() OVER (PARTITION BY description ORDER BY count(*) DESC, min(invoice), stock_code) AS rn FROM tx GROUP BY 1, 2) GROUP BY 1)"""
_CANON = f"""{_IDS}, canon AS (SELECT {_KEY} AS product_key, sku AS product_family_name, product_id, CAST(1 AS INTEGER) AS cluster, 'naive7' AS model_id, 'Weekly pattern' AS model_name, date AS forecast_date, pred AS forecast_value, CAST(NULL AS DOUBLE) AS p_sale, '{BUILT}' AS generated_at, y AS actual_value FROM naive JOIN ids USING (sku))"""


def metadata(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
    return V.product_metadata((retail_tx(spark, sf_dir) if tx is None else tx).withColumn("product_family_name", F.col("description")))


def forecasts(spark: SparkSession, sf_dir: str, known: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    pred = U.naive7(*split(spark, sf_dir, sums)).withColumnRenamed("sku", "product_family_name")
    return V.canonical(pred, 1, BUILT, known or metadata(spark, sf_dir), NAIVE)


@query(f"WITH {_CANON} SELECT * FROM canon", "naive")
def canonical_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry. Lines are joined once and written with the few columns that ids, aliases and forecasts come of."""
    tx = materialize(retail_tx(spark, sf_dir).select("invoice", "stock_code", "description", "date", "sales_amount"), "tx")
    known, sums = materialize(metadata(spark, sf_dir, tx), "metadata"), materialize(daily_sum(tx, "description"), "daily")
    return V.registry(forecasts(spark, sf_dir, known, sums), known)


@query(f"WITH {_CANON} SELECT product_key, product_family_name, {_NORM.format('product_family_name')} AS normalized_product_name, product_id, product_id AS product_id_norm, cluster, model_id, model_name, generated_at FROM canon GROUP BY ALL", "naive")
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).drop("search_aliases", "search_aliases_norm", "description_examples")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and codes as people write them, and some that are on no list."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.initcap("p_name").alias("query")).union(parts.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(". ")))).union(parts.select(F.concat_ws(" ", "p_type", "p_brand"))).union(parts.select(F.concat("p_name", F.lit(" discontinued")))).distinct()


_ASKED = "asked AS (SELECT DISTINCT array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS query FROM part UNION SELECT ' ' || CAST(p_partkey AS VARCHAR) || '. ' FROM part UNION SELECT p_type || ' ' || p_brand FROM part UNION SELECT p_name || ' discontinued' FROM part)"


@query(
    f"""WITH {_ASKED}, prod AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, {_NORM.format('p_name')} AS name, {_NORM.format("p_type || ' ' || p_brand")} AS alias FROM part),
    rules AS (SELECT DISTINCT 1 AS rule, id AS norm, k FROM prod UNION SELECT 2, name, k FROM prod UNION SELECT 3, alias, k FROM prod),
    best AS (SELECT query, rule, count(*) AS n FROM (SELECT query, {_NORM.format('query')} AS norm FROM asked) JOIN rules USING (norm) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY rule) = 1)
    SELECT query, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CAST(coalesce(n, 0) AS INTEGER) AS n_keys FROM asked LEFT JOIN best USING (query)"""
)
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.concat_ws(" ", "p_type", "p_brand")
    listed = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_key"), normalize_text(F.col("p_partkey").cast("string")).alias("product_id_norm"),
        normalize_text(F.col("p_name")).alias("normalized_product_name"), F.array(normalize_text(kinds)).alias("search_aliases_norm"),
    )
    return V.exact_matches(asked(spark, sf_dir), listed).select("query", "status", F.size("keys").alias("n_keys"))


@query()
def fuzzy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a typing error or words left out, against the registry."""
    names = table(spark, sf_dir, "part").select(F.concat(F.substring("p_name", 1, 4), F.substring("p_name", 6, 40)).alias("query")).distinct()
    return V.fuzzy_ranks(names, products(spark, sf_dir))


@query(
    """WITH listed AS (SELECT DISTINCT upper(p_name) AS f FROM part), q AS (SELECT DISTINCT 'give me a forecast for ' || p_name AS query, upper(p_name) AS f FROM part)
    SELECT query, f AS product_family_name, 'dropped' AS reason_type FROM q JOIN listed USING (f)"""
)
def unavailable_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.upper("p_name")
    listed = parts.select(name.alias("product_family_name"), normalize_text(name).alias("normalized_product_name"), F.lit("").alias("product_id_norm"), F.array().cast("array<string>").alias("search_aliases_norm"), F.lit("dropped").alias("reason_type")).distinct()
    return V.unavailable(parts.select(F.concat(F.lit("give me a forecast for "), "p_name").alias("query")).distinct(), listed).select("query", "product_family_name", "reason_type")


@query(f"WITH {_CANON} SELECT product_key, forecast_date, forecast_value FROM canon QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY forecast_date) <= 14", "naive")
def forecast_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir)
    wanted = rows.select("product_key").distinct()
    return V.lookup(rows, wanted, V.DEFAULT_HORIZON).select("product_key", "forecast_date", "forecast_value")


@query(f"WITH {_CANON} SELECT product_key, CAST(date_trunc('week', forecast_date) AS DATE) AS period_start, round(sum(forecast_value), 2) AS forecast_value, round(sum(actual_value), 2) AS actual_value, avg(p_sale) AS p_sale FROM canon GROUP BY 1, 2", "naive")
def display_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.display_weekly(forecasts(spark, sf_dir)).select("product_key", "period_start", F.round("forecast_value", 2).alias("forecast_value"), F.round("actual_value", 2).alias("actual_value"), "p_sale")


@query(f"WITH {_CANON} SELECT product_key, forecast_date AS date, 'forecast' AS segment, actual_value, forecast_value FROM canon UNION ALL SELECT {_KEY}, date, 'history', y, NULL FROM train WHERE date >= (SELECT test_start FROM cut) - 28", "naive")
def chart_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    edge = F.broadcast(test.agg(F.date_sub(F.min("date"), 28).alias("edge")))  # one row
    recent = train.crossJoin(edge).where("date >= edge").select(product_key(F.lit(1), F.col("sku")).alias("product_key"), "date", "y")
    return V.chart(recent, forecasts(spark, sf_dir))


@query(
    f"""WITH {_CANON}, e AS (SELECT product_key, count(*) AS n_days, sum(forecast_value) AS total, avg(forecast_value) AS mean, min_by(forecast_value, forecast_date) AS first, max_by(forecast_value, forecast_date) AS last, count(*) FILTER (WHERE forecast_value = 0) AS zero_days, avg(p_sale) AS p_sale FROM canon GROUP BY 1)
    SELECT product_key, CAST(n_days AS BIGINT) AS n_days, round(total, 2) AS total, round(mean, 4) AS mean, first, last, CAST(zero_days AS BIGINT) AS zero_days, CAST(p_sale AS DOUBLE) AS p_sale, CASE WHEN last > first * 1.1 THEN 'upward' WHEN first > last * 1.1 THEN 'downward' ELSE 'stable' END AS trend FROM e""",
    "naive",
)
def forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(forecasts(spark, sf_dir)).select("product_key", "n_days", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "first", "last", "zero_days", "p_sale", "trend")


@query(
    """SELECT DISTINCT 'Show me the next ' || CAST(p_size % 12 + 1 AS VARCHAR) || ' weeks for stock code ' || CAST(p_partkey AS VARCHAR) AS query, CAST(least((p_size % 12 + 1) * 7, 90) AS INTEGER) AS horizon_days, 'weekly' AS granularity, CAST(p_partkey AS VARCHAR) AS product_query FROM part
    UNION ALL SELECT DISTINCT 'Give me a daily forecast for ' || upper(p_name), CAST(14 AS INTEGER), 'daily', upper(p_name) FROM part"""
)
def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    one = F.concat(F.lit("Show me the next "), (F.col("p_size") % 12 + 1).cast("string"), F.lit(" weeks for stock code "), F.col("p_partkey").cast("string"))
    return V.parse_requests(parts.select(one.alias("query")).distinct().union(parts.select(F.concat(F.lit("Give me a daily forecast for "), F.upper("p_name"))).distinct()))


@query()
def resolve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade over part names as people write them: exact rules, then the nearest names with their margin."""
    return V.resolve(asked(spark, sf_dir), materialize(products(spark, sf_dir), "products"))


@query()
def answer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request gets: a product, an unavailable one, several that it may mean, or none."""
    known = materialize(products(spark, sf_dir), "products")
    kinds = table(spark, sf_dir, "part").select(F.upper(F.concat_ws(" ", "p_type", "p_brand")).alias("name")).distinct()
    listed = kinds.select(F.col("name").alias("product_family_name"), normalize_text(F.col("name")).alias("normalized_product_name"), F.lit("").alias("product_id_norm"), F.array().cast("array<string>").alias("search_aliases_norm"), F.lit("dropped").alias("reason_type"))
    return V.answer(asked(spark, sf_dir), known, listed)


_FUTURE = """future AS (SELECT sku, CAST(last + h AS DATE) AS date, h FROM (SELECT DISTINCT sku FROM daily) CROSS JOIN (SELECT max(date) AS last FROM daily) CROSS JOIN (SELECT CAST(unnest(range(1, 91)) AS INTEGER) AS h)),
    week AS (SELECT sku, y, 8 - row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS k FROM panel QUALIFY k >= 1)"""


@query(
    f"""WITH {_IDS}, {_FUTURE} SELECT {_KEY} AS product_key, sku AS product_family_name, product_id, CAST(1 AS INTEGER) AS cluster, 'naive7' AS model_id, 'Weekly pattern' AS model_name, future.date AS forecast_date, greatest(y, 0) AS forecast_value, CAST(NULL AS DOUBLE) AS p_sale, '{BUILT}' AS generated_at
    FROM future JOIN week USING (sku) JOIN ids USING (sku) WHERE week.k = (h - 1) % 7 + 1""",
    "panel",
)
def future_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forecasts of the 90 days after all that is known."""
    panel = dense(spark, sf_dir)
    pred = U.naive7(panel, future_grid(panel, V.LONGEST_HORIZON)).withColumnRenamed("sku", "product_family_name").drop("y")
    return V.canonical(pred, 1, BUILT, metadata(spark, sf_dir), NAIVE)


@query()
def future_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 days ahead by occurrence and size trees fitted on all known days, recursively, in the canonical form."""
    panel = dense(spark, sf_dir)
    model = L.fit_two_stage(L.training_rows(panel), tau=0.25)
    pred = L.recursive(panel, future_grid(panel, V.LONGEST_HORIZON), model).drop("y").withColumnsRenamed({"sku": "product_family_name", "pred": "pred_two_stage_lgbm"})
    return V.canonical(pred, 0, BUILT, metadata(spark, sf_dir))


@query()
def future_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 days ahead of every series by the model of each cluster, fitted on all known days: each written as an asset, read again and checked. The first and the
    last model share their trees and differ in their decisions; counts are of hundreds."""
    panel, known = materialize(dense(spark, sf_dir), "panel"), materialize(metadata(spark, sf_dir), "metadata")
    hundreds = panel.withColumn("y", F.greatest(F.col("y") / 100, F.lit(0.0)))
    rows = materialize(L.training_rows(panel), "rows")
    two = L.fit_two_stage(rows, tau=0.25)
    whole = L.fit_global(L.weight(rows), weight="weight")
    counted = L.fit_counts(L.training_rows(hundreds), cap=2000.0)
    out = None
    for cluster, past, model in ((0, panel, two), (1, hundreds, counted), (2, panel, whole), (3, panel, replace(two, tau=0.2, anchor=0.4))):
        pred = L.recursive(past, future_grid(panel, V.LONGEST_HORIZON), model, raw_state=cluster == 2).drop("y").withColumn("pred", F.col("pred") * (100 if cluster == 1 else 1))
        named = pred.withColumnsRenamed({"sku": "product_family_name", "pred": V.MODELS[cluster][2]})
        back = V.write_asset(V.canonical(named, cluster, BUILT, known), fresh_path(spark, f"asset-{cluster}") + ".csv")
        out = back if out is None else out.unionByName(back)
    return out
