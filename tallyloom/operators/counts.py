"""Zero-inflated Poisson and negative binomial regression by maximum likelihood over all rows.

The likelihood's value, gradient and Hessian are sums over rows. Tasks add them up over Arrow batches, Spark's partial aggregation adds up tasks,
and the driver sees one number per entry (some hundred), never a row. It then takes a damped Newton step: a step that doesn't raise the likelihood is not
taken and damped further, so the likelihood never falls. The dispersion is a parameter like the others."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.design import Design
from tallyloom.session import materialize, ship

STEPS = 40
#: Relative gain at which a fit ends, and the bounds of linear predictors and of the log dispersion.
GAIN, WIDE, DISPERSION = 1e-9, 30.0, (-9.0, 5.0)


@dataclass
class CountModel:
    """Log mean and logit of the inflation, each linear in standardised features; alpha 0 is Poisson."""

    design: Design
    features: list[str]
    inflation_features: list[str]
    mean: np.ndarray
    inflation: np.ndarray
    alpha: float
    cap: float = 200.0
    tau: float = 0.5
    trail: list[float] = field(default_factory=list)

    def expected(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and probability of a sale of rows of raw features (in the design's order)."""
        mu = np.exp(np.clip(self.design.values(rows, self.features) @ self.mean, -WIDE, math.log(self.cap) + 2))
        pi = 1 / (1 + np.exp(-np.clip(self.design.values(rows, self.inflation_features) @ self.inflation, -WIDE, WIDE)))
        zero = np.exp(-mu) if self.alpha <= 0 else np.power(1 + self.alpha * mu, -1 / self.alpha)
        return np.clip(np.nan_to_num((1 - pi) * mu), 0, self.cap), np.clip(np.nan_to_num(1 - (pi + (1 - pi) * zero)), 0, 1)

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forecast, 0 below the probability tau, and probability of a sale."""
        pred, p = self.expected(rows)
        return np.where(p >= self.tau, pred, 0.0), p


def slopes(n: np.ndarray, eta: np.ndarray, zeta: np.ndarray, theta: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of counts, and their derivatives by log mean, logit of inflation and log dispersion (theta None: Poisson), as columns."""
    mu, pi = np.exp(eta), 1 / (1 + np.exp(-zeta))
    zero, whole = n == 0, n.astype(int)
    top = int(whole.max(initial=0))
    if theta is None:
        log_zero, by_eta, by_theta = -mu, -mu, np.zeros_like(mu)
        table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
        log_own, own_eta, own_theta = n * eta - mu - table[whole], n - mu, np.zeros_like(mu)
    else:
        alpha, r = math.exp(theta), math.exp(-theta)
        spread = np.log1p(alpha * mu)
        log_zero, by_eta = -r * spread, -mu / (1 + alpha * mu)
        by_theta = r * spread + by_eta
        steps = np.arange(top)
        # log of Gamma(n + r) / Gamma(r), less that of n!, and its derivative by r
        table = np.concatenate([[0.0], np.cumsum(np.log(r + steps) - np.log(steps + 1))])
        table_r = np.concatenate([[0.0], np.cumsum(1 / (r + steps))])
        log_own = table[whole] + n * (theta + eta) - (n + r) * spread
        own_eta = (n - mu) / (1 + alpha * mu)
        own_theta = r * (spread - table_r[whole]) + own_eta
    rest = np.logaddexp(0.0, zeta)
    share = 1 / (1 + np.exp(np.clip(log_zero - zeta, -700, 700)))  # of zeros that are inflation
    value = np.where(zero, np.logaddexp(zeta, log_zero), log_own) - rest
    return value, np.stack([np.where(zero, (1 - share) * by_eta, own_eta), np.where(zero, share, 0.0) - pi, np.where(zero, (1 - share) * by_theta, own_theta)], 1)


def sums(x: np.ndarray, z: np.ndarray, n: np.ndarray, beta: np.ndarray, gamma: np.ndarray, theta: float | None, step: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and Hessian over rows; second derivatives by each predictor as central differences of the first."""
    eta, zeta = np.clip(x @ beta, -WIDE, WIDE), np.clip(z @ gamma, -WIDE, WIDE)
    value, first = slopes(n, eta, zeta, theta)
    second = np.empty((len(n), 3, 3))
    second[:, 0] = (slopes(n, eta + step, zeta, theta)[1] - slopes(n, eta - step, zeta, theta)[1]) / (2 * step)
    second[:, 1] = (slopes(n, eta, zeta + step, theta)[1] - slopes(n, eta, zeta - step, theta)[1]) / (2 * step)
    second[:, 2] = 0.0 if theta is None else (slopes(n, eta, zeta, theta + step)[1] - slopes(n, eta, zeta, theta - step)[1]) / (2 * step)
    parts = [x, z] + ([] if theta is None else [np.ones((len(n), 1))])
    gradient = np.concatenate([a.T @ first[:, k] for k, a in enumerate(parts)])
    hessian = np.block([[a.T @ (second[:, j, k, None] * b) for k, b in enumerate(parts)] for j, a in enumerate(parts)])
    return float(value.sum()), gradient, hessian


def summed(data: DataFrame, beta: np.ndarray, gamma: np.ndarray, theta: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """The same over a table (n, x, z), by a tree of partial sums."""
    p = len(beta) + len(gamma) + (theta is not None)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False)
            x, z = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False).reshape(len(n), -1) for c in ("x", "z"))
            value, gradient, hessian = sums(x, z, n, beta, gamma, theta)
            own = np.concatenate([[value], gradient, hessian.ravel()])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    got = np.zeros(1 + p + p * p)
    for r in data.mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # an entry each
        got[r.k] = r.v
    hessian = got[1 + p :].reshape(p, p)
    return got[0], got[1 : 1 + p], (hessian + hessian.T) / 2


def maximise(value_of, start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, list[float]]:
    """The point after at most `steps` moves of a damped Newton ascent, and the likelihoods on the way: value_of gives value, gradient and Hessian."""
    at, (value, gradient, hessian), damping = start, value_of(start), 1e-6
    trail = [value]
    while len(trail) <= steps and damping <= 1e8:
        scale = np.maximum(np.abs(np.diag(hessian)), 1e-8)
        low = np.linalg.eigvalsh(-hessian / np.sqrt(np.outer(scale, scale)))[0]
        move = np.linalg.solve(-hessian + np.diag(scale * (max(0.0, -low) + damping)), gradient)
        move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-300))
        if np.abs(move).max() < 1e-12:
            break
        new = value_of(at + move)
        if not np.isfinite(new[0]) or new[0] <= value:
            damping = max(damping * 10, 1e-4)
            continue
        gained, at, (value, gradient, hessian), damping = new[0] - value, at + move, new, max(damping / 10, 1e-9)
        trail.append(value)
        if gained <= GAIN * (abs(value) + 1):
            break
    return at, trail


def fit(rows: DataFrame, features: list[str], inflation_features: list[str] | None = None, target: str = "y", distribution: str = "zinb", cap: float = 200.0, tau: float = 0.5, steps: int = STEPS) -> CountModel:
    """Fitted on all rows; counts are the target, rounded half to even and cut to 0 .. cap (a null target counts as 0). Without rows, or without any
    count above 0, means are as small as predictors go and the trail is short; that is no error."""
    if distribution not in ("zip", "zinb"):
        raise ValueError(f"unknown distribution: {distribution}")
    spark = rows.sparkSession
    ship(spark)
    inflation_features = inflation_features or features
    design = Design.fit(rows, list(dict.fromkeys([*features, *inflation_features])))
    counts = F.least(F.bround(F.greatest(F.coalesce(F.col(target).cast("double"), F.lit(0.0)), F.lit(0.0))), F.lit(float(cap)))
    data = materialize(rows.select(counts.alias("n"), design.row(features).alias("x"), design.row(inflation_features).alias("z")), "design")
    mean, zeros = data.agg(F.avg(F.when(F.col("n") > 0, F.col("n"))), F.avg((F.col("n") == 0).cast("double"))).first()
    a, b = len(features) + 1, len(inflation_features) + 1
    share = min(max((zeros if zeros is not None else 1.0) * 0.5, 0.01), 0.99)
    start = np.zeros(a + b + (distribution == "zinb"))
    start[0], start[a] = math.log(max(mean or 0.01, 0.01)), math.log(share / (1 - share))
    theta = lambda w: float(np.clip(w[-1], *DISPERSION)) if distribution == "zinb" else None
    best, trail = maximise(lambda w: summed(data, w[:a], w[a : a + b], theta(w)), start, steps)
    alpha = math.exp(theta(best)) if distribution == "zinb" else 0.0
    return CountModel(design, list(features), list(inflation_features), best[:a], best[a : a + b], alpha, cap, tau, trail)
