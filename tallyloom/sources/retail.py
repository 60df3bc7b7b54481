"""The retail view over the star-schema tables: transactions with returns, product descriptions and customer countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invoice line. Returned lines have negative quantity and amount. Orders meet their customers first, and lines carry finished
    values, so that a large table of lines is shuffled twice, by order and by part, with few bytes a row. The dimension tables are small against
    the lines; which of them are broadcast is left to the measured sizes."""
    lines, orders, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    back = F.col("l_returnflag") == "R"
    bought = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
        .select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("n_name").alias("country"))
    )
    sold = lines.select(
        F.col("l_orderkey").alias("invoice"),
        "l_partkey",
        F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.when(back, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("sales_amount"),
        F.col("l_shipdate").alias("invoice_ts"),
        F.to_date("l_shipdate").alias("date"),
    )
    joined = sold.join(bought, sold.invoice == bought.o_orderkey).join(parts, sold.l_partkey == parts.p_partkey)
    return joined.select(
        "invoice",
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("brand"),
        "quantity",
        "price",
        "sales_amount",
        "invoice_ts",
        "date",
        "customer_id",
        "country",
        F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("line"),
    )
