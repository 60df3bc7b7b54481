"""The augmented Dickey-Fuller test: lags by AIC over nested least squares, its p-value from the response surface."""

from __future__ import annotations

import math

import numpy as np

LAGS = 7
LEAST = 20

#: MacKinnon's (1994) response surface for a constant and one series: the least and largest statistic, where the two
#: polynomials meet, and their coefficients by rising power.
TAU_LEAST, TAU_MEET, TAU_MOST = -18.83, -1.61, 2.74
BELOW = (2.1659, 1.4412, 0.038269)
ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)


def p_value(statistic: float) -> float:
    if statistic > TAU_MOST:
        return 1.0
    if statistic < TAU_LEAST:
        return 0.0
    z = sum(c * statistic**k for k, c in enumerate(BELOW if statistic <= TAU_MEET else ABOVE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def design(y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences, and for each: a constant, the level before it, and the lags differences before it."""
    step = np.diff(y)
    n = len(step) - lags
    return step[lags:], np.column_stack([np.ones(n), y[lags:-1], *(step[lags - k : len(step) - k] for k in range(1, lags + 1))])


def chosen_lags(y: np.ndarray, most: int) -> int:
    """The number of lags of the least AIC. All of them are regressions on the first columns of one design over the same rows, so a single
    triangular factor gives every sum of squares."""
    target, x = design(y, most)
    n = len(target)
    upper = np.linalg.qr(np.column_stack([x, target]), mode="r")
    explained = np.cumsum(upper[:-1, -1] ** 2)
    left = np.maximum(target @ target - explained, upper[-1, -1] ** 2)[1:]
    aic = n * np.log(np.maximum(left, 1e-300) / n) + 2 * np.arange(2, most + 3)
    return int(np.argmin(aic))


def adf(y: np.ndarray, most: int = LAGS) -> tuple[float | None, float | None, int | None]:
    """The statistic, its p-value and the lags used, of a unit root against a level; None for short, constant or degenerate series."""
    y = np.asarray(y, float)
    if len(y) < LEAST or y.std() == 0:
        return None, None, None
    most = min(most, (len(y) - 1) // 2 - 2)
    lags = chosen_lags(y, most)
    target, x = design(y, lags)
    try:
        inverse = np.linalg.inv(x.T @ x)
    except np.linalg.LinAlgError:
        return None, None, None
    beta = inverse @ (x.T @ target)
    rest = target - x @ beta
    error = math.sqrt(max(rest @ rest, 0.0) / (len(target) - x.shape[1]) * max(inverse[1, 1], 0.0))
    if not error:
        return None, None, None
    statistic = float(beta[1] / error)
    return statistic, p_value(statistic), lags
