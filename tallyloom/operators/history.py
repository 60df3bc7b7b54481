"""Features from a series' own past. All windows are by sku in date order and end the day before, so no feature sees its own day."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import ship

NEVER = 999


def by() -> Window:
    """A sku's rows in date order."""
    return Window.partitionBy("sku").orderBy("date")


def past() -> Window:
    """All rows of a sku before a row."""
    return by().rowsBetween(Window.unboundedPreceding, -1)


def before(w: int) -> Window:
    """The last w days before a row."""
    return by().rowsBetween(-w, -1)


def lag(y: Column, k: int, clip: bool = False) -> Column:
    out = F.coalesce(F.lag(y, k).over(by()), F.lit(0.0))
    return F.greatest(out, F.lit(0.0)) if clip else out


def sold(y: Column) -> Column:
    return (y > 0).cast("double")


def days_since_sale(y: Column, most: int | None = None) -> Column:
    """Days since the last day with a sale before this; NEVER without one."""
    out = F.coalesce(F.datediff("date", F.last(F.when(y > 0, F.col("date")), ignorenulls=True).over(past())), F.lit(NEVER))
    return out if most is None else F.least(out, F.lit(most))


def rows_since_sale(y: Column) -> Column:
    """Rows since the last sale as of yesterday (0: yesterday); NEVER without one. Needs rows without gaps."""
    rn = F.row_number().over(by())
    return F.coalesce((rn - 1 - F.max(F.when(y > 0, rn)).over(past())).cast("int"), F.lit(NEVER))


def lagged(panel: DataFrame, lags: tuple[int, ...] = (1, 7, 14, 28), windows: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """Lags, and means, population deviations and sale rates over the days before. One sort serves all windows."""
    y = F.col("y")
    columns = {f"lag_{k}": lag(y, k) for k in lags} | {f"lag_is_sale_{k}": F.coalesce(F.lag(sold(y), k).over(by()), F.lit(0.0)) for k in lags}
    for w in windows:
        columns |= {f"roll_mean_{w}": F.coalesce(F.avg(y).over(before(w)), F.lit(0.0)), f"roll_std_{w}": F.coalesce(F.stddev_pop(y).over(before(w)), F.lit(0.0)), f"sale_rate_{w}": F.coalesce(F.avg(sold(y)).over(before(w)), F.lit(0.0))}
    return panel.withColumns(columns | {"days_since_sale": days_since_sale(y)})


def zero_led(panel: DataFrame, windows: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Means where the missing day before the first counts as a zero, of clipped values, with the sale rates."""
    first = panel.withColumn("__prev", lag(F.col("y"), 1, clip=True))
    columns = {}
    for w in windows:
        frame = by().rowsBetween(-(w - 1), 0)
        columns |= {f"roll_mean_{w}": F.avg("__prev").over(frame), f"sale_rate_{w}": F.avg(sold(F.col("__prev"))).over(frame)}
    return first.withColumns(columns | {"rows_since_sale": rows_since_sale(F.col("y")), "log_lag_1": F.log1p("__prev")}).drop("__prev")


def ewm(panel: DataFrame, specs: dict[str, tuple[Callable[[Column], Column], int]]) -> DataFrame:
    """Exponentially weighted means over the days before: name -> (expression of y, span). Nulls of an expression are gaps, which age
    the weights; the first day gets 0. The recurrence is sequential, so a series is one Arrow batch of its sku; an array fold inside
    Catalyst would copy its result once a day."""
    ship(panel.sparkSession)
    spans = {name: span for name, (_, span) in specs.items()}
    given = panel.select("sku", "date", "y", *[expr(F.col("y")).cast("double").alias(name) for name, (expr, _) in specs.items()])

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        for name, span in spans.items():
            rows[name] = rows[name].ewm(span=span, adjust=False, ignore_na=False).mean().shift(1).fillna(0.0)
        return rows

    return given.groupBy("sku").applyInPandas(each, given.schema)


def decay(last: Column, prior: Column, beta: float, h: Column) -> Column:
    """A last value that fades towards a prior over the horizon."""
    return last * F.pow(F.lit(beta), h) + prior * (F.lit(1.0) - F.pow(F.lit(beta), h))


def profile(train: DataFrame) -> DataFrame:
    """One row per sku of a dense training panel: level, spread, intermittency, recent values."""
    pos = F.when(F.col("y") > 0, F.col("y"))
    w = Window.partitionBy("sku").orderBy(F.desc("date"))
    rows = train.withColumns({"__rn": F.row_number().over(w), "__t": F.row_number().over(by())})
    n_pos = F.count(pos)
    recent = lambda k: F.avg(F.when(F.col("__rn") <= k, F.col("y")))
    at = lambda k: F.max(F.when(F.col("__rn") == k, F.col("y")))
    out = rows.groupBy("sku").agg(
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("std"),
        F.sum("y").alias("total"),
        F.avg((F.col("y") > 0).cast("double")).alias("nonzero_rate"),
        F.avg((F.col("y") <= 0).cast("double")).alias("zero_rate"),
        F.coalesce(F.avg(pos), F.lit(0.0)).alias("pos_mean"),
        F.coalesce(F.median(pos), F.lit(0.0)).alias("pos_median"),
        F.coalesce(F.try_divide(F.count("*"), n_pos), F.count("*").cast("double")).alias("adi"),
        F.coalesce(F.pow(F.try_divide(F.stddev_pop(pos), F.avg(pos)), 2), F.lit(0.0)).alias("cv2"),
        F.coalesce(F.try_divide(F.max(F.when(pos.isNotNull(), F.col("__t"))) - F.min(F.when(pos.isNotNull(), F.col("__t"))), n_pos - 1), F.count("*").cast("double")).alias("mean_gap"),
        F.coalesce(F.max_by(pos, F.when(pos.isNotNull(), F.col("date"))), F.lit(0.0)).alias("last_nonzero"),
        F.max(F.when(pos.isNotNull(), F.col("date"))).alias("last_sale"),
        at(1).alias("last_1"),
        F.coalesce(at(7), F.lit(0.0)).alias("last_7"),
        recent(7).alias("recent_7"),
        recent(28).alias("recent_28"),
    )
    return out


def horizon_index(future: DataFrame) -> DataFrame:
    """future with h: 1 for a sku's first day."""
    return future.withColumn("h", F.row_number().over(by()))


#: How fast each recent value fades towards its prior over the horizon.
PROXY_BETA = {"lag_1": 0.75, "lag_7": 0.88, "roll_7": 0.90, "roll_28": 0.96}
OCCURRENCE_BETA = {"lag_1": 0.65, "lag_7": 0.85, "roll_7": 0.85, "roll_14": 0.90, "roll_28": 0.95, "ewm_7": 0.85, "ewm_28": 0.95}


def proxies(future: DataFrame, known: DataFrame) -> DataFrame:
    """Stand-ins for lags over the horizon: the last known values fade towards the training mean."""
    base = horizon_index(future).join(known.select("sku", "mean", "last_1", "last_7", "recent_7", "recent_28"), "sku", "left")
    last = {"lag_1": "last_1", "lag_7": "last_7", "roll_7": "recent_7", "roll_28": "recent_28"}
    return base.select("sku", "date", "h", *[decay(F.coalesce(c, F.lit(0.0)), F.coalesce("mean", F.lit(0.0)), PROXY_BETA[n], F.col("h")).alias(f"proxy_{n}") for n, c in last.items()])


def occurrence_proxies(future: DataFrame, train: DataFrame) -> DataFrame:
    """The same for sale flags: recent rates fade towards the training sale rate."""
    rn = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))
    rows = train.select("sku", sold(F.col("y")).alias("o"), rn.alias("rn"), F.count("*").over(Window.partitionBy("sku")).alias("n"))
    rate = lambda k: F.avg(F.when(F.col("rn") <= k, F.col("o")))
    at = lambda k: F.coalesce(F.max(F.when(F.col("rn") == k, F.col("o"))), F.lit(0.0))


    def smoothed(span: int) -> Column:
        """The last value of an exponential mean that begins with the first day: weights fall by the distance from the end."""
        keep = 1 - 2 / (span + 1)
        return F.sum(F.col("o") * F.when(F.col("rn") == F.col("n"), F.pow(F.lit(keep), F.col("rn") - 1)).otherwise((1 - keep) * F.pow(F.lit(keep), F.col("rn") - 1)))

    last = rows.groupBy("sku").agg(smoothed(7).alias("ewm_7"), smoothed(28).alias("ewm_28"), F.avg("o").alias("prior"), at(1).alias("lag_1"), at(7).alias("lag_7"), rate(7).alias("roll_7"), rate(14).alias("roll_14"), rate(28).alias("roll_28"))
    base = horizon_index(future).join(last, "sku", "left")
    return base.select("sku", "date", "h", *[decay(F.coalesce(n, F.lit(0.0)), F.coalesce("prior", F.lit(0.0)), OCCURRENCE_BETA[n], F.col("h")).alias(f"occ_{n}") for n in OCCURRENCE_BETA])


def recency_weight(df: DataFrame, most: float = 2.0) -> DataFrame:
    """df with weight: rising linearly with the rank of the date from 1 to most."""
    dates = df.select("date").distinct().withColumns({"r": F.row_number().over(Window.orderBy("date")), "n": F.count("*").over(Window.partitionBy())})
    scale = dates.select("date", (F.lit(1.0) + (F.lit(most) - 1.0) * (F.col("r") - 1) / F.greatest(F.lit(1), F.col("n") - 1)).alias("weight"))
    return df.join(F.broadcast(scale), "date")
