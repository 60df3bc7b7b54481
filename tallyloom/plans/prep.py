"""Cleaning and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import prep
from tallyloom.plans.registry import query
from tallyloom.session import fresh_path
from tallyloom.sources import resume
from tallyloom.sources.retail import retail_tx, table


@query(
    """WITH holes AS (SELECT l_orderkey AS invoice, l_linenumber AS line_no, CAST(l_partkey AS VARCHAR) AS stock_code,
        CASE WHEN l_linenumber % 3 = 0 THEN '  ' WHEN l_linenumber % 5 = 0 THEN NULL ELSE p_name END AS description
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    known AS (SELECT stock_code, description AS found FROM (SELECT stock_code, description, row_number() OVER (PARTITION BY stock_code ORDER BY invoice, line_no, description) AS rn
        FROM holes WHERE trim(coalesce(description, '')) <> '') WHERE rn = 1)
    SELECT coalesce(nullif(trim(description), ''), found) AS description, CAST(count(*) AS BIGINT) AS n_lines
    FROM holes LEFT JOIN known USING (stock_code) WHERE coalesce(nullif(trim(description), ''), found) IS NOT NULL GROUP BY 1"""
)
def tx_clean_fill_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n = F.col("l_linenumber")
    holes = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("invoice"), n.alias("line_no"), F.col("l_partkey").cast("string").alias("stock_code"),
        F.when(n % 3 == 0, "  ").when(n % 5 == 0, None).otherwise(F.col("p_name")).alias("description"),
    )
    filled = prep.fill_descriptions(holes, [F.col("invoice"), F.col("line_no"), F.col("description")])
    return filled.groupBy("description").agg(F.count("*").alias("n_lines"))


@query(
    """SELECT CASE WHEN n >= 2 THEN family ELSE description END AS product_family_name, CAST(count(*) AS BIGINT) AS n_lines, round(sum(sales_amount), 2) AS total
    FROM (SELECT *, upper(regexp_replace(split_part(description, ' ', 1) || ' ' || brand, '\\s+', '', 'g')) AS family FROM tx)
    JOIN (SELECT upper(regexp_replace(split_part(description, ' ', 1) || ' ' || brand, '\\s+', '', 'g')) AS family, count(DISTINCT stock_code) AS n FROM tx GROUP BY 1) USING (family) GROUP BY 1""",
    "tx",
)
def family_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = retail_tx(spark, sf_dir)
    named = prep.family_rule(tx, F.concat_ws(" ", F.element_at(F.split("description", " "), 1), "brand"))
    return named.groupBy("product_family_name").agg(F.count("*").alias("n_lines"), F.round(F.sum("sales_amount"), 2).alias("total"))


NORMAL = r"trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"


@query(
    f"""SELECT p_partkey AS part, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS cleaned, regexp_replace(upper(name), '\\s+', '', 'g') AS no_space,
        {NORMAL.format('name')} AS normal, replace({NORMAL.format('name')}, ' ', '') AS family
    FROM (SELECT p_partkey, '  ' || p_name || ' -  ' || p_brand || '/' || p_type || ' ' AS name FROM part)"""
)
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("  "), F.col("p_name"), F.lit(" -  "), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(" "))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), X.normalize_desc(name).alias("cleaned"), X.family_no_space(name).alias("no_space"),
        X.normalize_text(name).alias("normal"), X.normalize_family(name).alias("family"),
    )


@query(
    f"""SELECT p_partkey AS part, slug, 'c' || CAST(p_size % 4 AS VARCHAR) || '-' || slug || '-' || md5({NORMAL.format('name')})[1:8] AS product_key FROM (
        SELECT *, coalesce(nullif(regexp_replace(replace(lower({NORMAL.format('name')}), ' ', '-')[1:48], '-+$', ''), ''), 'product') AS slug
        FROM (SELECT *, p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name AS name FROM part))"""
)
def product_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), X.slugify(name).alias("slug"), X.product_key(F.col("p_size") % 4, name).alias("product_key"))


_COLORS = "[" + ", ".join(f"'{w}'" for w in X.COLOR_WORDS) + "]"
_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


_FAMILIES = f"""WITH named AS (SELECT DISTINCT 'The ' || p_name || ' set of ' || CAST(p_size AS VARCHAR) || ' ' || p_brand AS description FROM part),
    meant AS (SELECT description, list_filter(regexp_extract_all(upper(description), '[A-Z0-9]+'), lambda t: NOT list_contains({_STOPS}, t)) AS t FROM named),
    parted AS (SELECT description, list_filter(t, lambda x: list_contains({_COLORS}, x) OR (regexp_full_match(x, '[A-Z]{{3,8}}') AND x NOT IN ('SET', 'PACK'))) AS v,
        list_filter(t, lambda x: NOT (list_contains({_COLORS}, x) OR (regexp_full_match(x, '[A-Z]{{3,8}}') AND x NOT IN ('SET', 'PACK')))) AS f FROM meant)
    SELECT description, coalesce(nullif(array_to_string(f[1:4], ' '), ''), description) AS family_name, coalesce(array_to_string(v[1:6], ' '), '') AS variant_hint FROM parted"""


@query(_FAMILIES)
def family_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(F.concat(F.lit("The "), "p_name", F.lit(" set of "), F.col("p_size").cast("string"), F.lit(" "), "p_brand").alias("description")).distinct()
    return named.select("description", X.heuristic_family(F.col("description")).alias("r")).select("description", "r.family_name", "r.variant_hint")


@query(_FAMILIES)
def resumed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same families as keyed batches: a first run that stops after half of them, and a second one that goes on."""
    path = fresh_path(spark, "families")
    named = table(spark, sf_dir, "part").select(F.concat(F.lit("The "), "p_name", F.lit(" set of "), F.col("p_size").cast("string"), F.lit(" "), "p_brand").alias("description"))
    work = lambda rows: rows.select("description").distinct().select("description", X.heuristic_family(F.col("description")).alias("r")).select("description", "r.family_name", "r.variant_hint")
    resume.run(named, "description", work, path, batches=4, most=2)
    return resume.run(named, "description", work, path, batches=4)


@query("SELECT country, CAST(count(*) AS BIGINT) AS n_lines, round(sum(sales_amount), 2) AS total FROM tx WHERE lower(trim(country)) = 'nation_7' AND price > 0 GROUP BY 1", "tx")
def country_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = retail_tx(spark, sf_dir).where(prep.same_text("country", " Nation_7 ") & (F.col("price") > 0))
    return tx.groupBy("country").agg(F.count("*").alias("n_lines"), F.round(F.sum("sales_amount"), 2).alias("total"))


_SPLIT = "SELECT tx.*, CASE WHEN epoch_us(invoice_ts) <= edge THEN 'train' ELSE 'test' END AS split FROM tx, (SELECT quantile_cont(epoch_us(invoice_ts)::DOUBLE, 0.7) AS edge FROM tx)"


@query(f"SELECT split, CAST(count(*) AS BIGINT) AS n_lines, min(date) AS first_date, max(date) AS last_date, round(sum(sales_amount), 2) AS total FROM ({_SPLIT}) GROUP BY 1", "tx")
def time_quantile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = prep.split_at_quantile(retail_tx(spark, sf_dir), "invoice_ts")
    return split.groupBy("split").agg(F.count("*").alias("n_lines"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.sum("sales_amount"), 2).alias("total"))


@query(
    f"""WITH parted AS ({_SPLIT}), kept AS (SELECT stock_code FROM parted WHERE split = 'train' GROUP BY 1 HAVING round(sum(sales_amount), 2) >= 100000)
    SELECT split, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT stock_code) AS BIGINT) AS n_codes FROM parted WHERE stock_code IN (SELECT stock_code FROM kept) GROUP BY 1""",
    "tx",
)
def train_cutoff_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = prep.split_at_quantile(retail_tx(spark, sf_dir), "invoice_ts")
    kept = prep.with_least_total(split, "stock_code", "sales_amount", 100000 - 0.005, F.col("split") == "train")
    return kept.groupBy("split").agg(F.count("*").alias("n_lines"), F.count_distinct("stock_code").alias("n_codes"))


@query(
    """SELECT copies, CAST(count(*) AS BIGINT) AS groups FROM (SELECT CAST(count(*) AS BIGINT) AS copies FROM lineitem
    GROUP BY l_orderkey, l_suppkey % 10, l_returnflag HAVING count(*) > 1) GROUP BY 1"""
)
def dup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("s"), "l_returnflag")
    return prep.duplicate_groups(lines).groupBy("copies").agg(F.count("*").alias("groups"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows FROM lineitem WHERE (l_orderkey, l_suppkey % 10, l_returnflag) IN (SELECT (l_orderkey, l_suppkey % 10, l_returnflag) FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("s"), "l_returnflag")
    return prep.members_of_groups(lines, prep.duplicate_groups(lines), lines.columns).agg(F.count("*").alias("n_rows"))


@query("SELECT CAST(count(*) AS BIGINT) AS groups, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_share FROM (SELECT invoice, count(DISTINCT date) + max(CASE WHEN date IS NULL THEN 1 ELSE 0 END) AS n FROM tx GROUP BY 1)", "tx")
def dup_invoice_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.constant_share(retail_tx(spark, sf_dir), "invoice", "date").select("groups", F.round("single_share", 6).alias("single_share"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS \"distinct\" FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    )
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.null_profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    """SELECT CAST(try_cast(split_part(raw, 'T', 1) AS DATE) AS DATE) AS date, trim(sku) AS sku, round(sum(greatest(coalesce(try_cast(v AS DOUBLE), 0), 0)), 2) AS y FROM (
        SELECT CASE WHEN l_linenumber = 7 THEN 'no date' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS raw, ' ' || p_brand AS sku,
        CASE WHEN l_linenumber = 6 THEN 'n/a' WHEN l_returnflag = 'R' THEN CAST(-l_quantity AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS v FROM lineitem JOIN part ON l_partkey = p_partkey)
    WHERE try_cast(raw AS DATE) IS NOT NULL GROUP BY 1, 2"""
)
def conform_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n = F.col("l_linenumber")
    raw = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.when(n == 7, "no date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Date "),
        F.concat(F.lit(" "), "p_brand").alias("StockCode"),
        F.when(n == 6, "n/a").when(F.col("l_returnflag") == "R", (-F.col("l_quantity")).cast("string")).otherwise(F.col("l_quantity").cast("string")).alias("total_sales"),
    )
    daily = prep.conform_daily(prep.rename_synonyms(raw), clip_negative=True)
    return daily.select("date", "sku", F.round("y", 2).alias("y"))
