"""Cleaning, splitting and profiling of transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import family_no_space, is_blank, normalize_desc


def fill_descriptions(tx: DataFrame, order: list[Column], code: str = "stock_code", desc: str = "description") -> DataFrame:
    """Blank descriptions get the first non-blank one of their code; rows that stay blank go."""
    known = tx.where(~is_blank(F.col(desc))).groupBy(code).agg(F.min_by(desc, F.struct(*order)).alias("__known"))
    filled = tx.join(known, code, "left").withColumn(desc, normalize_desc(F.when(is_blank(F.col(desc)), F.col("__known")).otherwise(F.col(desc))))
    return filled.where(F.col(desc) != "").drop("__known")


def family_rule(tx: DataFrame, family: Column, desc: str = "description", code: str = "stock_code", least_codes: int = 2) -> DataFrame:
    """product_family_name: the family's normal form where it spans at least so many codes, else the description."""
    named = tx.withColumn("__family", family_no_space(family))
    wide = named.groupBy("__family").agg(F.count_distinct(code).alias("n")).where(F.col("n") >= least_codes).select("__family", F.lit(True).alias("__wide"))
    return named.join(wide, "__family", "left").withColumn("product_family_name", F.when(F.col("__wide"), F.col("__family")).otherwise(F.col(desc))).drop("__family", "__wide")


def same_text(column: str, value: str) -> Column:
    """Case-folded, trimmed equality."""
    return F.lower(F.trim(F.col(column))) == value.strip().lower()


def time_quantile(tx: DataFrame, ts: str, q: float = 0.7) -> DataFrame:
    """One row: the quantile of a timestamp, in microseconds, linear between neighbours."""
    return tx.agg(F.percentile(F.unix_micros(F.col(ts).cast("timestamp")), q).alias("at"))


def split_at_quantile(tx: DataFrame, ts: str, q: float = 0.7) -> DataFrame:
    """tx with split: train up to the quantile of ts, test after it."""
    cut = F.broadcast(time_quantile(tx, ts, q))  # one row
    return tx.crossJoin(cut).withColumn("split", F.when(F.unix_micros(F.col(ts).cast("timestamp")) <= F.col("at"), "train").otherwise("test")).drop("at")


def with_least_total(tx: DataFrame, key: str, measure: str, least: float, where: Column | None = None) -> DataFrame:
    """Rows of keys whose measure sums to at least so much (over the rows of where)."""
    base = tx if where is None else tx.where(where)
    return tx.join(base.groupBy(key).agg(F.sum(measure).alias("s")).where(F.col("s") >= least).select(key), key, "left_semi")


def conform_daily(df: DataFrame, date: str = "date", sku: str = "sku", y: str = "y", cluster: str | None = None, clip_negative: bool = False) -> DataFrame:
    """Daily rows of the right types, one per key: unreadable dates go, unreadable measures are 0, keys are trimmed."""
    value = F.coalesce(F.col(y).try_cast("double"), F.lit(0.0))
    value = F.greatest(value, F.lit(0.0)) if clip_negative else value
    keys = [F.to_date(F.try_to_timestamp(F.col(date).cast("string"))).alias("date"), F.trim(F.col(sku)).alias("sku"), *([F.col(cluster).try_cast("int").alias("cluster")] if cluster else [])]
    rows = df.select(*keys, value.alias("y")).where("date IS NOT NULL AND sku IS NOT NULL" + (" AND cluster IS NOT NULL" if cluster else ""))
    return rows.groupBy("date", "sku", *(["cluster"] if cluster else [])).agg(F.sum("y").alias("y"))


#: The names under which a demand table may bring its columns.
SYNONYMS = {"total_sales": "y", "quantity": "y", "sales": "y", "product_family_name": "sku", "stockcode": "sku", "stock_code": "sku", "cluster_kmeans": "cluster"}


def rename_synonyms(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed column names with the known synonyms; an error names what is missing."""
    out = df.toDF(*[SYNONYMS.get(c.strip().lower(), c.strip().lower()) for c in df.columns])
    missing = {"date", "sku", "y"} - set(out.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """A row per column: rows, nulls and distinct values, in one pass and one unpivot."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in df.columns], *[F.count_distinct(c).alias(f"{c}__distinct") for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct")) for c in df.columns]))
    return one.select("n_rows", rows.alias("r")).select("r.column", "n_rows", "r.nulls", "r.distinct")


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Groups of equal rows (nulls are equal) with more than one, and their sizes."""
    return df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("copies")).where("copies > 1")


def members_of_groups(df: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of df that are in groups, null-safe on all columns."""
    return df.join(groups, reduce(lambda a, b: a & b, [df[c].eqNullSafe(groups[c]) for c in columns]), "left_semi")


def constant_share(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row: groups of key, and the share with a single value of column (null is a value)."""
    each = df.groupBy(key).agg((F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))).alias("n"))
    return each.agg(F.count("*").alias("groups"), F.avg((F.col("n") == 1).cast("double")).alias("single_share"))


def top_values(df: DataFrame, key: str, value: str, order: str, n: int = 5) -> DataFrame:
    """key and its n most frequent values as an array; of equal counts the one first seen in order."""
    counted = df.where(~is_blank(F.col(value))).groupBy(key, value).agg(F.count("*").alias("c"), F.min(order).alias("o"))
    ranked = counted.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), "o", value))).where(F.col("rn") <= n)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda s: s[value]).alias("top"))
