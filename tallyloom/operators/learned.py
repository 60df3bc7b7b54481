"""Learned demand models on Spark ML: two-stage boosted trees, a global boosted regression, a zero-inflated count model; and recursive
forecasts by them. Fitting is distributed; a fitted model is small (trees as arrays, coefficients as numbers) and goes to the tasks
that walk series forward, a day at a time for many of them, as every step needs the one before."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import calendar
from tallyloom.operators import counts
from tallyloom.operators import history as H
from tallyloom.operators.design import Design
from tallyloom.session import ship

LAGS, WINDOWS = (1, 7, 14, 28), (7, 28)
FEATURES = [*(f"lag_{k}" for k in LAGS), *(f"roll_mean_{w}" for w in WINDOWS), *(f"sale_rate_{w}" for w in WINDOWS), "days_since_sale", "dow", "month", "is_weekend", "is_q4"]
KEPT = 28
#: Series that step together in a task, about.
SERIES = 500


def training_rows(panel: DataFrame) -> DataFrame:
    """The features of each day, all known the day before."""
    days = calendar.features(F.col("date"))
    out = H.lagged(panel, LAGS, WINDOWS).withColumns({n: days[n] for n in ("dow", "month", "is_weekend", "is_q4")})
    return out.select("sku", "date", "y", *[F.col(c).cast("double").alias(c) for c in FEATURES])


@dataclass
class Trees:
    """Boosted trees as arrays, a row per tree: split feature (-1 in leaves), threshold, children, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """The weighted sum of all trees for rows of features."""
        out = np.zeros(len(rows))
        for t, weight in enumerate(self.weights):
            at = np.zeros(len(rows), int)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = rows[np.arange(len(rows)), np.maximum(f, 0)] <= self.threshold[t, at]
                at = np.where(inner, np.where(go_left, self.left[t, at], self.right[t, at]), at)
            out += weight * self.value[t, at]
        return out


def export_trees(model) -> Trees:
    """The arrays of a fitted Spark ensemble."""
    rows = []
    for tree in model.trees:
        nodes: list[tuple[int, float, int, int, float]] = []

        def walk(node, nodes=nodes) -> int:
            k = len(nodes)
            nodes.append((-1, 0.0, 0, 0, float(node.prediction())))
            if node.subtreeDepth() > 0:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[k] = (split.featureIndex(), split.threshold(), left, right, 0.0)
            return k

        walk(tree._call_java("rootNode"))
        rows.append(nodes)
    width = max(map(len, rows))
    filled = np.array([r + [(-1, 0.0, 0, 0, 0.0)] * (width - len(r)) for r in rows])
    return Trees(filled[..., 0].astype(int), filled[..., 1], filled[..., 2].astype(int), filled[..., 3].astype(int), filled[..., 4], np.array(model.treeWeights))


@dataclass
class TwoStage:
    """Occurrence and size: either may be a constant where training had one class or no sale."""

    occurs: Trees | None
    rate: float
    size: Trees | None
    spread: float
    tau: float = 0.2
    anchor: float = 0.0
    floor: float = 0.0
    cap: float = math.inf

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forecast and probability of a sale."""
        p = np.full(len(rows), self.rate) if self.occurs is None else 1 / (1 + np.exp(-2 * self.occurs(rows)))
        size = np.zeros(len(rows)) if self.size is None else np.maximum(np.expm1(np.minimum(self.size(rows) + self.spread / 2, 30.0)), 0)
        pred = (1 - self.anchor) * np.maximum(p * size, 0) + self.anchor * rows[:, FEATURES.index("lag_7")]
        pred = np.minimum(np.where(p >= self.tau, pred, 0.0), self.cap)
        return np.where(pred >= self.floor, pred, 0.0), p


def _vector(rows: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def occurrence_trees(data: DataFrame, trees: int = 15, depth: int = 4, seed: int = 42, leaf: int = 20) -> Trees:
    """Boosted trees for the label (both classes must occur) over the vectors of features."""
    return export_trees(GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=leaf).fit(data))


def size_trees(sold: DataFrame, trees: int = 15, depth: int = 4, weight: str | None = None, seed: int = 42, leaf: int = 20) -> tuple[Trees, float]:
    """Boosted trees for the target of sale days, and the variance of what they leave."""
    model = GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=leaf, **({"weightCol": weight} if weight else {})).fit(sold)
    spread = model.transform(sold).agg(F.var_samp(F.col("target") - F.col("prediction"))).first()[0]
    return export_trees(model), max(float(spread or 0.0), 0.0)


def fit_two_stage(rows: DataFrame, trees: int = 15, depth: int = 4, weight: str | None = None, seed: int = 42, **decisions: float) -> TwoStage:
    """Trees for whether a day has a sale, and for the log of its size; the variance of the size's residuals corrects its mean."""
    data = _vector(rows).withColumn("label", (F.col("y") > 0).cast("double")).persist()
    try:
        counted = data.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
        pos, n = counted.pos or 0.0, counted.n
        occurs = occurrence_trees(data, trees, depth, seed) if 0 < pos < n else None
        if not pos:
            return TwoStage(occurs, 0.0, None, 0.0, **decisions)
        sold = data.where("label = 1").withColumn("target", F.log1p("y"))
        size, spread = size_trees(sold, trees, depth, weight, seed)
        return TwoStage(occurs, pos / n, size, spread if pos > 20 else 0.0, **decisions)
    finally:
        data.unpersist()


@dataclass
class LogLinear:
    """The log of one more than demand has a mean whose log is linear in standardised features."""

    design: Design
    weights: np.ndarray
    cap: float = math.inf

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.exp(np.clip(self.design.values(rows) @ self.weights, -30.0, math.log(30.0)))
        return np.minimum(np.expm1(mean), self.cap), np.ones(len(rows))


#: Losses of fit_global(): the first two by boosted trees, the others by a log link.
LOSSES = ("squared", "absolute", "poisson", "tweedie")


def fit_global(rows: DataFrame, trees: int = 15, depth: int = 4, weight: str | None = None, seed: int = 42, loss: str = "squared", power: float = 1.5, cap: float = math.inf) -> TwoStage | LogLinear:
    """One regression of the log of clipped demand over all skus, which always sells. loss is one of LOSSES; power is that of Tweedie's variance, between 1 and 2."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    weighted = {"weightCol": weight} if weight else {}
    target = F.log1p(F.greatest("y", F.lit(0.0)))
    if loss in ("squared", "absolute"):
        data = _vector(rows).withColumn("target", target)
        model = GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, seed=seed, lossType=loss, **weighted).fit(data)
        return TwoStage(None, 1.0, export_trees(model), 0.0, tau=0.0, cap=cap)
    design = Design.fit(rows, FEATURES)
    data = rows.select(target.alias("target"), array_to_vector(F.array(*[design.number(c) for c in FEATURES])).alias("features"), *weighted.values())
    family = {"family": "poisson", "link": "log"} if loss == "poisson" else {"family": "tweedie", "variancePower": power, "linkPower": 0.0}
    # a little ridge, as features may be constant or one the sum of others
    model = GeneralizedLinearRegression(labelCol="target", regParam=1e-6, **family, **weighted).fit(data)
    return LogLinear(design, np.r_[model.intercept, model.coefficients.toArray()], cap)


def fit_counts(rows: DataFrame, steps: int = counts.STEPS, cap: float = 200.0, dispersion: bool = True) -> counts.CountModel:
    """The zero-inflated model of counts by maximum likelihood over all rows, negative binomial or Poisson."""
    return counts.fit(rows, FEATURES, cap=cap, distribution="zinb" if dispersion else "zip", steps=steps)


class Histories:
    """The last KEPT values and sale flags of many series, right-aligned, with their lengths and the days since their last sales."""

    def __init__(self, values: list[np.ndarray]) -> None:
        self.n = np.array([len(v) for v in values])
        self.values = np.stack([np.r_[np.zeros(max(0, KEPT - len(v))), v[-KEPT:]] for v in values]).astype(float)
        self.sold = np.stack([np.r_[np.zeros(max(0, KEPT - len(v))), v[-KEPT:] > 0] for v in values]).astype(float)
        self.since = np.array([float(len(v) - at[-1]) if len(at := np.flatnonzero(v > 0)) else float(H.NEVER) for v in values])

    @classmethod
    def reduced(cls, n: list[int], since: list[float], last: list[np.ndarray]) -> Histories:
        """From what reduced_history() keeps of each."""
        out = cls(last)
        out.n, out.since = np.array(n, int), np.array(since, float)
        return out

    def features(self, of: np.ndarray, days: pd.DatetimeIndex) -> np.ndarray:
        """FEATURES of the day after each history in of, as training_rows has them."""
        n, values, sold_ = self.n[of], self.values[of], self.sold[of]
        lags = [np.where(n >= k, values[:, -k], 0.0) for k in LAGS]
        over = [np.maximum(np.minimum(n, w), 1) for w in WINDOWS]
        means = [values[:, -w:].sum(1) / m for w, m in zip(WINDOWS, over, strict=True)]
        rates = [sold_[:, -w:].sum(1) / m for w, m in zip(WINDOWS, over, strict=True)]
        return np.stack([*lags, *means, *rates, self.since[of], days.weekday, days.month, days.weekday >= 5, days.month >= 10], 1).astype(float)

    def append(self, of: np.ndarray, values: np.ndarray, sold: np.ndarray) -> None:
        for held, new in ((self.values, values), (self.sold, sold.astype(float))):
            held[of, :-1] = held[of, 1:]
            held[of, -1] = new
        self.n[of] += 1
        self.since[of] = np.where(sold, 1.0, np.where(self.since[of] == H.NEVER, H.NEVER, self.since[of] + 1))


def reduced_history(train: DataFrame) -> DataFrame:
    """sku, n (its days), since (days from its last sale on) and last (its last KEPT values): all that a step needs, whatever the length."""
    ago = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))
    rows = train.select("sku", "date", F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y")).withColumn("ago", ago)
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("ago") <= KEPT, F.struct((-F.col("ago")).alias("k"), "y")))), lambda r: r["y"])
    return rows.groupBy("sku").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(F.col("y") > 0, F.col("ago"))).cast("double"), F.lit(float(H.NEVER))).alias("since"), held.alias("last"))


Model = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _walk(past: pd.DataFrame, ahead: pd.DataFrame, models: list[Model], raw_state: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forecasts and probabilities of ahead's rows (in order of sku and date) by each model, from histories as reduced_history() has them."""
    known = past.set_index("sku")
    names = ahead["sku"].unique()
    held = [known.loc[s] if s in known.index else None for s in names]
    of, step = pd.Categorical(ahead["sku"], names).codes.astype(int), ahead.groupby("sku").cumcount().to_numpy()
    days, out = pd.DatetimeIndex(ahead["date"]), []
    for model in models:
        state = Histories.reduced([0 if h is None else h["n"] for h in held], [H.NEVER if h is None else h["since"] for h in held], [np.zeros(0) if h is None else np.asarray(h["last"], float) for h in held]) if len(names) else None
        preds, ps = np.zeros(len(ahead)), np.zeros(len(ahead))
        for t in range(int(step.max(initial=-1)) + 1):
            at = np.flatnonzero(step == t)
            pred, p = model(state.features(of[at], days[at]))
            preds[at], ps[at] = pred, p
            state.append(of[at], np.where(pred == 0, p * pred, pred) if raw_state else pred, pred > 0)
        out.append((preds, ps))
    return out


def _cogrouped(train: DataFrame, future: DataFrame, each: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, together: int) -> DataFrame:
    """each() over groups of about `together` skus: their reduced histories and future rows."""
    ship(train.sparkSession)
    groups = max(1, -(-future.select("sku").distinct().count() // together))
    group = F.pmod(F.xxhash64("sku"), F.lit(groups)).alias("group")
    # both sides may come of one table: aliases give their columns names of their own
    left = reduced_history(train).select(*[F.col(c).alias(c) for c in ("sku", "n", "since", "last")], group)
    right = future.select(*[F.col(c).alias(c) for c in ("sku", "date", "y")], group)
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(each, schema)


def recursive(train: DataFrame, future: DataFrame, model: Model, raw_state: bool = False, together: int = SERIES) -> DataFrame:
    """future's rows with pred and p_sale: each day's forecast becomes history of the next. Histories are reduced in Catalyst to a row a sku; series are independent,
    so about `together` of them form a group, which steps all of them a day at a time with one call of the model. raw_state: the state takes
    forecasts before the gate."""

    def each(past: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        ahead = ahead.sort_values(["sku", "date"])
        pred, p = _walk(past, ahead, [model], raw_state)[0]
        return pd.DataFrame({"sku": ahead["sku"], "date": ahead["date"], "y": ahead["y"].astype(float), "pred": pred, "p_sale": p})

    return _cogrouped(train, future, each, "sku string, date date, y double, pred double, p_sale double", together)


def recursive_each(train: DataFrame, future: DataFrame, models: list[Model], raw_state: bool = False, together: int = SERIES) -> DataFrame:
    """The same by several models at once: future's rows with preds, an array of a forecast by each. Histories and days are shuffled once, whatever the number of models."""

    def each(past: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        ahead = ahead.sort_values(["sku", "date"])
        preds = np.stack([pred for pred, _ in _walk(past, ahead, models, raw_state)], 1)
        return pd.DataFrame({"sku": ahead["sku"], "date": ahead["date"], "y": ahead["y"].astype(float), "preds": list(preds)})

    return _cogrouped(train, future, each, "sku string, date date, y double, preds array<double>", together)


def score(rows: DataFrame, model: TwoStage) -> DataFrame:
    """rows with pred and p_sale in one pass, without recursion."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            pred, p = model(batch[FEATURES].to_numpy(float))
            yield pd.DataFrame({"sku": batch["sku"], "date": batch["date"], "y": batch["y"], "pred": pred, "p_sale": p})

    return rows.mapInPandas(run, "sku string, date date, y double, pred double, p_sale double")


def weight(rows: DataFrame, most: float = 2.0) -> DataFrame:
    """rows with weight: recent, selling and large days count more."""
    recent = H.recency_weight(rows, most)
    high = F.broadcast(rows.agg(F.greatest(F.coalesce(F.percentile(F.when(F.col("y") > 0, F.col("y")), 0.9), F.lit(1.0)), F.lit(1.0)).alias("__h")))  # one row
    sells = F.when(F.col("y") > 0, 1.5).otherwise(1.0)
    volume: Column = 1 + F.least(F.greatest(F.col("y"), F.lit(0.0)) / F.col("__h"), F.lit(2.0))
    return recent.crossJoin(high).withColumn("weight", F.col("weight") * sells * volume).drop("__h")
