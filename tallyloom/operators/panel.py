"""Dense panels: every key on every date, absent days as zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_sum(tx: DataFrame, key: str, date: str = "date", measure: str = "sales_amount", digits: int = 2) -> DataFrame:
    """sku, date, y: rounded to cents, so that y does not depend on the order of the sum. Null keys go."""
    return tx.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("sku"), F.col(date).alias("date")).agg(F.round(F.sum(measure), digits).alias("y"))


def spine(df: DataFrame, date: str = "date", step: str = "1 day") -> DataFrame:
    """All dates from the first to the last."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("date"))


def zero_panel(daily: DataFrame, skus: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """sku, date, y for every sku on every date. The grid grows from the distinct skus: each carries its date array, which explodes
    in place, so there is no cross join of rows."""
    skus = (daily if skus is None else skus).select("sku").distinct()
    ends = (daily if dates is None else dates).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = skus.crossJoin(F.broadcast(ends)).where("a IS NOT NULL").select("sku", F.explode(F.sequence("a", "b")).alias("date"))
    return grid.join(daily, ["sku", "date"], "left").select("sku", "date", F.coalesce("y", F.lit(0.0)).alias("y"))


def weekly_panel(daily: DataFrame) -> DataFrame:
    """sku, week (its Sunday), y over each sku's own range of weeks, gaps as zero."""
    weekly = daily.groupBy("sku", F.next_day(F.date_sub("date", 1), "SUN").alias("week")).agg(F.round(F.sum("y"), 2).alias("y"))
    own = weekly.groupBy("sku").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    grid = own.select("sku", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 days"))).alias("week"))
    return grid.join(weekly, ["sku", "week"], "left").select("sku", "week", F.coalesce("y", F.lit(0.0)).alias("y"))


def future_grid(panel: DataFrame, horizon: int) -> DataFrame:
    """sku, date and y = 0 for the days after the panel's last."""
    last = panel.agg(F.max("date").alias("last"))
    return panel.select("sku").distinct().crossJoin(F.broadcast(last)).select("sku", F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.date_add("last", h))).alias("date"), F.lit(0.0).alias("y"))


def last_days_split(panel: DataFrame, days: int) -> DataFrame:
    """panel with is_test: the last so many distinct dates."""
    dates = panel.select("date").distinct()
    ranked = dates.withColumn("__r", F.dense_rank().over(Window.orderBy(F.desc("date"))))  # a row per date
    return panel.join(F.broadcast(ranked.where(F.col("__r") <= days).agg(F.min("date").alias("__from"))), how="cross").withColumn("is_test", F.col("date") >= F.col("__from")).drop("__from")


def fraction_split(panel: DataFrame, fraction: float = 0.8) -> DataFrame:
    """panel with is_valid: dates after the first fraction of distinct dates (at least one on either side)."""
    dates = panel.select("date").distinct().withColumns({"r": F.row_number().over(Window.orderBy("date")), "n": F.count("*").over(Window.partitionBy())})
    cut = dates.where(F.col("r") == F.greatest(F.lit(1), F.least(F.floor(F.col("n") * fraction), F.col("n") - 1))).select(F.col("date").alias("__cut"))
    return panel.join(F.broadcast(cut), how="cross").withColumn("is_valid", F.col("date") > F.col("__cut")).drop("__cut")


def clamped_holdout(n: Column, wanted: int = 42, least: int = 14, minimum: int = 56) -> Column:
    """Days to hold out of n: as many as wanted, at most a third, at least `least`; null if there are fewer than minimum."""
    return F.when(n >= minimum, F.greatest(F.lit(least), F.least(F.lit(wanted), F.floor(n / 3)))).cast("int")


def shrinking_holdout(n: Column, wanted: int = 42, spare: int = 14, least: int = 7) -> Column:
    """Days to hold out of n: as many as wanted, or a fifth of them (at least `least`) where hardly more than those would be left."""
    return F.when(n <= wanted + spare, F.greatest(F.lit(least), F.floor(n / 5))).otherwise(wanted).cast("int")


def holdout(panel: DataFrame, days: Callable[[Column], Column], name: str = "is_valid") -> DataFrame:
    """panel with a flag: whether a row is one of the last days(n) of its sku's n rows; false where days(n) is null."""
    own = Window.partitionBy("sku")
    ranked = panel.withColumns({"__r": F.row_number().over(own.orderBy(F.desc("date"))), "__n": F.count("*").over(own)})
    return ranked.withColumn(name, F.coalesce(F.col("__r") <= days(F.col("__n")), F.lit(False))).drop("__r", "__n")


def series(panel: DataFrame, order: str = "date", value: str = "y") -> DataFrame:
    """sku and its values as one array in order."""
    return panel.groupBy("sku").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("values"))


def periods(df: DataFrame, n: int = 4, date: str = "date") -> DataFrame:
    """date and period P1..Pn: the distinct dates in n runs of nearly equal length."""
    return df.select(date).distinct().select(date, F.concat(F.lit("P"), F.ntile(n).over(Window.orderBy(date)).cast("string")).alias("period"))


def gap_filled_weeks(daily: DataFrame, sums: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """A row per sku and week from Monday on, between the sku's first and last week: sums (0 in gaps) and means (null in gaps)."""
    week = F.to_date(F.date_trunc("week", "date")).alias("period_start")
    weekly = daily.groupBy("sku", week).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.avg(c).alias(n) for n, c in means.items()])
    own = weekly.groupBy("sku").agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    grid = own.select("sku", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 days"))).alias("period_start"))
    return grid.join(weekly, ["sku", "period_start"], "left").select("sku", "period_start", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in sums], *means)
