"""The exponential smoothing family: level, trend (none, additive, multiplicative, each damped or not), season (none, additive, multiplicative).

Parameters are fitted by a bounded simplex search on the sum of squared one-step errors. Series don't depend on each other, so the recursion runs
over time for a whole batch at once, and the search, from the best point of a coarse grid, moves every series' simplex in step: an evaluation is one
pass over time for all series and all trial points. Spark deals (batch of skus, model) to tasks; the competition, whose winner each series' own last days choose, is an
aggregate over the scores, and only winners are fitted again on all days."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize, ship

VALID = 14
#: Weights of a trial's score: error of the hold-out, false sales on its days without sales. Fixed values.
ERROR, FALSE_SALES = 0.7, 0.3
#: Added to transformed values of multiplicative models, which need positive ones. Fixed value.
OFFSET = 1e-3
#: Series of a task, about.
BATCH = 200
#: Moves of a search's rounds, and the parameter values (as shares of their range) of the grid that it begins from.
STEPS, GRID = 15, (0.05, 0.35, 0.8)
LOW, HIGH = {"alpha": 1e-4, "beta": 1e-4, "gamma": 1e-4, "phi": 0.8}, {"alpha": 0.9999, "beta": 0.9999, "gamma": 0.9999, "phi": 0.995}


@dataclass(frozen=True)
class Model:
    trend: str | None = None
    seasonal: str | None = None
    damped: bool = False
    period: int = 7
    log: bool = True

    @property
    def name(self) -> str:
        if not self.trend and not self.seasonal:
            base = "ses"
        else:
            base = f"{self.trend or 'none'}{'_damped' if self.damped else ''}" + (f"_{self.seasonal}{self.period}" if self.seasonal else "")
        return base + ("" if self.log else "_raw")

    @property
    def free(self) -> list[str]:
        return ["alpha", *(["beta"] if self.trend else []), *(["gamma"] if self.seasonal else []), *(["phi"] if self.damped else [])]

    @property
    def least(self) -> int:
        """Values that a series needs."""
        return 2 * self.period if self.seasonal else 3

    def forward(self, y: np.ndarray) -> np.ndarray:
        x = np.log1p(np.maximum(y, 0.0)) if self.log else y.astype(float)
        return np.maximum(x + OFFSET, OFFSET) if "mul" in (self.trend, self.seasonal) else x

    def back(self, x: np.ndarray) -> np.ndarray:
        x = x - OFFSET if "mul" in (self.trend, self.seasonal) else x
        return np.maximum(np.expm1(np.clip(x, -50, 50)) if self.log else x, 0.0)


MODELS = [Model(), Model("add"), Model("add", damped=True), Model(None, "add"), Model(None, "mul"), Model("add", "add"), Model("add", "add", True), Model("add", "mul", True), Model("mul", "mul", True)]


def beginning(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend and season before the first value, of series (rows): from the first two periods, or the first ten values."""
    if model.seasonal:
        first, second = x[:, : model.period], x[:, model.period : 2 * model.period]
        level = first.mean(1)
        slope = (second.mean(1) - level) / model.period
        season = np.stack([first, second]).mean(0)
        middle = season.mean(1)
        season = season - middle[:, None] if model.seasonal == "add" else np.maximum(season, 1e-8) / np.maximum(middle, 1e-8)[:, None]
    else:
        own = x[:, :10]
        t = np.arange(own.shape[1])
        slope = ((t - t.mean()) * own).sum(1) / ((t - t.mean()) ** 2).sum()
        level, season = own.mean(1) - slope * (t.mean() + 1), np.zeros((len(x), 1))
        level = own[:, 0] if not model.trend else level
    if model.trend == "mul":
        return np.maximum(level, 1e-8), np.clip(1 + slope / np.maximum(level, 1e-8), 0.5, 2.0), season
    return level, slope, season


def run(x: np.ndarray, model: Model, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray, phi: np.ndarray, horizon: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared one-step errors of series (rows) for trial parameters (rows, trials), and forecasts (rows, trials, horizon)."""
    shape, period = alpha.shape, model.period if model.seasonal else 1
    level, slope, start = (np.broadcast_to(c[..., None] if c.ndim == 1 else c.T[:, :, None], (*([period] if c.ndim > 1 else []), *shape)).copy() for c in beginning(x, model))
    season, error = list(start), np.zeros(shape)
    mul_trend, mul_season = model.trend == "mul", model.seasonal == "mul"
    with np.errstate(all="ignore"):
        for t in range(x.shape[1]):
            value, s = x[:, t, None], season[t % period]
            base = level if not model.trend else level * slope**phi if mul_trend else level + phi * slope
            guess = base * s if mul_season else base + s if model.seasonal else base
            error += (value - guess) ** 2
            free = value / np.maximum(s, 1e-8) if mul_season else value - s if model.seasonal else value
            before, level = level, alpha * free + (1 - alpha) * base
            if mul_trend:
                level = np.maximum(level, 1e-8)
                slope = np.clip(beta * (level / before) + (1 - beta) * slope**phi, 0.5, 2.0)
            elif model.trend:
                slope = beta * (level - before) + (1 - beta) * phi * slope
            if mul_season:
                season[t % period] = np.maximum(gamma * value / np.maximum(base, 1e-8) + (1 - gamma) * s, 1e-8)
            elif model.seasonal:
                season[t % period] = gamma * (value - base) + (1 - gamma) * s
        out = np.empty((*shape, horizon))
        reach = np.zeros(shape)
        for h in range(horizon):
            reach = reach + phi ** (h + 1)
            base = level if not model.trend else level * slope**reach if mul_trend else level + reach * slope
            s = season[(x.shape[1] + h) % period]
            out[..., h] = base * s if mul_season else base + s if model.seasonal else base
    return np.where(np.isfinite(error), error, 1e300), out


def simplex(cost: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = STEPS, rounds: int = 2, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The best point within bounds of each row's own search (rows, p), and its cost. cost takes (rows, trials, p). Nelder and Mead's moves, all
    rows at once: a row's four trial points are costed together, then each row takes its move. A bound flattens a simplex, so each round but
    the first begins with a fresh one around the best point."""
    rows, p = start.shape
    at = np.arange(rows)
    for k in range(rounds):
        points = np.repeat(start[:, None], p + 1, 1)
        for j in range(p):
            wide = (0.15 if k == 0 else 0.05) * (high[j] - low[j])
            points[:, j + 1, j] += np.where(points[:, j + 1, j] + wide <= high[j], wide, -wide)
        points, costs = _search(cost, np.clip(points, low, high), low, high, steps, tolerance)
        best = np.argmin(costs, 1)
        start, least = points[at, best], costs[at, best]
    return start, least


def _search(cost: Callable[[np.ndarray], np.ndarray], points: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    costs, at = cost(points), np.arange(len(points))
    for _ in range(steps):
        order = np.argsort(costs, 1, kind="stable")
        points, costs = np.take_along_axis(points, order[..., None], 1), np.take_along_axis(costs, order, 1)
        if (costs[:, -1] - costs[:, 0] <= tolerance * (np.abs(costs[:, 0]) + 1e-12)).all():
            break
        centre, worst = points[:, :-1].mean(1), points[:, -1]
        trials = np.clip(np.stack([centre + c * (centre - worst) for c in (1.0, 2.0, 0.5, -0.5)], 1), low, high)
        own = cost(trials)
        reflect, expand, outer, inner = own.T
        best, second, last = costs[:, 0], costs[:, -2], costs[:, -1]
        take = np.where(reflect < best, np.where(expand < reflect, 1, 0), np.where(reflect < second, 0, np.where((reflect < last) & (outer <= reflect), 2, np.where((reflect >= last) & (inner < last), 3, -1))))
        moved = take >= 0
        points[moved, -1] = trials[at[moved], take[moved]]
        costs[moved, -1] = own[at[moved], take[moved]]
        if not moved.all():
            shrunk = points[:, :1] + 0.5 * (points - points[:, :1])
            points = np.where(moved[:, None, None], points, shrunk)
            costs = np.where(moved[:, None], costs, cost(points))
    return points, costs


def fit(y: np.ndarray, model: Model, horizon: int = 0, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Fitted parameters (1 or 0 where a model has none), sse on the model's scale, and forecasts of series (rows) of equal length."""
    x, free = model.forward(y), model.free
    fixed = {"alpha": 0.0, "beta": 0.0, "gamma": 0.0, "phi": 1.0}

    def full(points: np.ndarray) -> list[np.ndarray]:
        return [points[..., free.index(n)] if n in free else np.full(points.shape[:-1], v) for n, v in fixed.items()]

    bounds = [np.array([b[n] for n in free]) for b in (LOW, HIGH)]
    grid = bounds[0] + (bounds[1] - bounds[0]) * np.array(list(itertools.product(GRID, repeat=len(free))))
    cost = lambda points: run(x, model, *full(points))[0]
    first = np.argmin(cost(np.broadcast_to(grid, (len(y), *grid.shape))), 1)
    best, sse = simplex(cost, grid[first], *bounds, steps)
    own = full(best[:, None])
    return {n: v[:, 0] for n, v in zip(fixed, own, strict=True)} | {"sse": sse, "forecast": model.back(run(x, model, *own, horizon)[1][:, 0])}


def score(kept: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Of rows: weighted absolute percentage error, and the share of days without a sale that are forecast to have one."""
    zero = kept <= 0
    false = np.divide(((guess > 0) & zero).sum(1), zero.sum(1), out=np.zeros(len(kept)), where=zero.any(1))
    return ERROR * np.abs(kept - guess).sum(1) / np.maximum(np.abs(kept).sum(1), 1.0) + FALSE_SALES * false


COLUMNS = "sku string, model string, n long, alpha double, beta double, gamma double, phi double, sse double, score double, forecast array<double>"


def fits(dealt: DataFrame, models: list[Model], horizon: int, valid: int, steps: int = STEPS) -> DataFrame:
    """A row for each sku and model of dealt (sku, series, bucket, model): fitted without the last valid days and scored on them, or on all
    days with a forecast, if valid is 0. A series too short for a model has no row."""
    ship(dealt.sparkSession)
    by_name = {m.name: m for m in models}

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        model, out = by_name[rows["model"].iloc[0]], []
        sizes = rows["series"].map(len)
        for n, same in rows.groupby(sizes):
            if n - valid < model.least:
                continue
            y = np.stack(same["series"].to_list()).astype(float)
            own = fit(y[:, : n - valid], model, valid or horizon, steps)
            part = pd.DataFrame({"sku": same["sku"].to_numpy(), "model": model.name, "n": n} | {k: own[k] for k in ("alpha", "beta", "gamma", "phi", "sse")})
            part["score"] = score(y[:, n - valid :], own["forecast"]) if valid else np.nan
            part["forecast"] = list(own["forecast"]) if not valid else [None] * len(part)
            out.append(part)
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in COLUMNS.split(", ")})

    return dealt.groupBy("bucket", "model").applyInPandas(each, COLUMNS)


def series(panel: DataFrame, batch: int = BATCH) -> DataFrame:
    """sku, series (values by date, null as 0) and bucket: a batch of skus has one bucket."""
    rows = panel.groupBy("sku").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y")))), lambda d: d["y"]).alias("series"))
    rows = materialize(rows, "series")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("sku"), F.lit(max(1, -(-rows.count() // batch)))))


def parameters(panel: DataFrame, models: list[Model], steps: int = STEPS) -> DataFrame:
    """sku, model, n, alpha, beta, gamma, phi, sse and resid_var of each model fitted on all days."""
    dealt = series(panel).withColumn("model", F.explode(F.array(*[F.lit(m.name) for m in models])))
    return fits(dealt, models, 0, 0, steps).select("sku", "model", "n", "alpha", "beta", "gamma", "phi", "sse", (F.col("sse") / F.col("n")).alias("resid_var"))


def chosen(panel: DataFrame, horizon: int, models: list[Model] | None = None, valid: int = VALID, steps: int = STEPS) -> DataFrame:
    """sku, model, score, tried (models that could be fitted), parameters and sse of the winner on all days, and its forecast (array).

    A series too short for the competition gets no row; equal scores go to the model that stands first."""
    models = models or MODELS
    own = series(panel)
    dealt = own.withColumn("model", F.explode(F.array(*[F.lit(m.name) for m in models])))
    trials = materialize(fits(dealt, models, 0, valid, steps), "trials")
    place = F.array_position(F.array(*[F.lit(m.name) for m in models]), F.col("model"))
    best = trials.groupBy("sku").agg(F.min_by(F.struct("model", "score"), F.struct(F.coalesce("score", F.lit(float("inf"))), place)).alias("b"), F.count("*").alias("tried"))
    winners = own.join(best.select("sku", "b.model", "tried", F.col("b.score").alias("won")), "sku")
    again = fits(winners.select("sku", "series", "bucket", "model"), models, horizon, 0, steps)
    return again.join(winners.select("sku", "won", "tried"), "sku").select("sku", "model", F.col("won").alias("score"), "tried", "alpha", "beta", "gamma", "phi", "sse", "forecast")


def forecast(panel: DataFrame, horizon: int, models: list[Model] | None = None, valid: int = VALID) -> DataFrame:
    """sku, model, h (from 1) and pred of each series' chosen model."""
    rows = chosen(panel, horizon, models, valid)
    return rows.select("sku", "model", F.posexplode("forecast").alias("h", "pred")).withColumn("h", F.col("h") + 1)
