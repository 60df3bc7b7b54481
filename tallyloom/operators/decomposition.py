"""Seasonal-trend decomposition by local regression (STL), robust, of whole arrays of series.

After Cleveland, Cleveland, McRae and Terpenning (1990): an inner loop smooths each season's own sub-series by local linear regression with tricube weights,
takes the low-pass part out of them, and smooths what is left as the trend; an outer loop weights points by the bisquare of their residual, so
single peaks don't bend trend or season. Defaults: seasonal span 7, trend span the least odd number not below 1.5 periods over (1 - 1.5 / 7),
two inner rounds for each of 15 robust ones.

Local regression on an even grid has fixed geometry: windows and tricube weights are made once for a length and span; a smoothing is then a
weighted sum over a window axis, for all series of a batch at once. Series are independent, so Spark groups them by sku; nothing but a
sku's own days meets in a task."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.session import ship

SEASONAL = 7
INNER, OUTER = 2, 15
#: Floats of a smoothing's windows at once.
WINDOWS = 50_000


@lru_cache(maxsize=64)
def geometry(n: int, span: int, beyond: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places -beyond .. n - 1 + beyond: the points of each place's window, their distances from it, and tricube weights."""
    at = np.arange(-beyond, n + beyond)
    width = min(span, n)
    left = np.clip(at - (span + 1) // 2 + 1, 0, n - width) if span < n else np.zeros(len(at), int)
    points = left[:, None] + np.arange(width)
    away = points - at[:, None]
    reach = np.maximum(at - left, left + width - 1 - at)[:, None].astype(float) + (max(0, span - n) // 2)
    far = np.abs(away) / np.maximum(reach, 1e-300)
    weights = np.where(far <= 0.001, 1.0, np.where(far <= 0.999, (1 - np.minimum(far, 1) ** 3) ** 3, 0.0))
    return points, away.astype(float), weights


def loess(y: np.ndarray, span: int, rho: np.ndarray | None = None, beyond: int = 0) -> np.ndarray:
    """Local linear regression along the last axis, at its points and beyond further ones at each end; rho: robustness weights."""
    n = y.shape[-1]
    points, away, tricube = geometry(n, span, beyond)
    flat = y.reshape(-1, n)
    rows = max(1, WINDOWS // points.size)
    if len(flat) > rows:
        weights = [None] * len(flat) if rho is None else rho.reshape(-1, n)
        parts = [loess(flat[k : k + rows], span, None if rho is None else weights[k : k + rows], beyond) for k in range(0, len(flat), rows)]
        return np.concatenate(parts).reshape(*y.shape[:-1], n + 2 * beyond)
    w = tricube if rho is None else tricube * rho[..., points]
    total = w.sum(-1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    centre = (w * away).sum(-1, keepdims=True)
    spread = (w * (away - centre) ** 2).sum(-1, keepdims=True)
    sloped = np.sqrt(spread) > 0.001 * (n - 1)
    tilt = np.divide(-centre, spread, out=np.zeros_like(spread), where=sloped)
    out = (w * (1 + tilt * (away - centre)) * y[..., points]).sum(-1)
    # without weight a place keeps its own value
    own = y[..., np.clip(np.arange(-beyond, n + beyond), 0, n - 1)]
    return np.where(np.broadcast_to(total[..., 0] > 0, out.shape), out, own)


def _mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([np.zeros((*x.shape[:-1], 1)), x], -1), -1)
    return (total[..., width:] - total[..., :-width]) / width


def _seasonal(free: np.ndarray, rho: np.ndarray, period: int, span: int) -> np.ndarray:
    """Each season's sub-series, smoothed and continued by a place at either end, back in order: n + 2 periods."""
    n = free.shape[-1]
    out = np.empty((*free.shape[:-1], n + 2 * period))
    for first, last in ((0, n % period), (n % period, period)):  # those with a value more, and the rest
        if first == last:
            continue
        at = np.arange(first, last)[:, None] + period * np.arange(-(-(n - first) // period))
        smooth = loess(free[..., at], span, rho[..., at], 1)
        place = np.arange(first, last)[:, None] + period * np.arange(smooth.shape[-1])
        out[..., place] = smooth
    return out


def odd(x: float) -> int:
    """The least odd number not below x."""
    up = int(np.ceil(x))
    return up + (up % 2 == 0)


def stl(y: np.ndarray, period: int, seasonal: int = SEASONAL, trend: int | None = None, low: int | None = None, inner: int = INNER, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Season, trend and robustness weights of series along the last axis, each of one period at least; outer 0: not robust."""
    y = np.asarray(y, float)
    n = y.shape[-1]
    if period < 2 or n < period:
        raise ValueError(f"a decomposition of period {period} needs as many values, not {n}")
    trend = trend or odd(1.5 * period / (1 - 1.5 / seasonal))
    low = low or odd(period + 1)
    season, level, rho = np.zeros_like(y), np.zeros_like(y), np.ones_like(y)
    for k in range(outer + 1):
        for _ in range(inner):
            cycle = _seasonal(y - level, rho, period, seasonal)
            passed = loess(_mean(_mean(_mean(cycle, period), period), 3), low)
            season = cycle[..., period : period + n] - passed
            level = loess(y - season, trend, rho)
        if k < outer:
            rest = np.abs(y - season - level)
            bound = 6 * np.median(rest, -1, keepdims=True)
            rest = np.where(bound > 1e-12 * np.abs(y).max(-1, keepdims=True), rest, 0.0)  # what is left is rounding only
            share = np.divide(rest, bound, out=np.zeros_like(rest), where=bound > 0)
            rho = np.where(rest <= 0.001 * bound, 1.0, np.where(rest <= 0.999 * bound, (1 - share**2) ** 2, 0.0))
    return season, level, rho


def strengths(y: np.ndarray, period: int) -> np.ndarray:
    """1 - Var(rest) / Var(rest + season) of the robust decompositions of series (rows); 0 for a series without variation."""
    season, level, _ = stl(y, period)
    rest = y - season - level
    whole, alone = np.var(rest + season, -1), np.var(rest, -1)
    varies = whole > 1e-12 * np.maximum(1.0, np.var(y, -1))
    return np.where(varies, 1 - np.divide(alone, whole, out=np.ones_like(whole), where=varies), 0.0)


def strength(y: np.ndarray, period: int, least_periods: float = 2) -> float | None:
    """The same of one series; None below so many periods."""
    y = np.asarray(y, float)
    return None if len(y) < max(least_periods * period, period) else float(strengths(y[None], period)[0])


def components(panel: DataFrame, period: int = 7, **spans: int) -> DataFrame:
    """sku, date, y, season, trend, rest and weight: each series' robust decomposition. A series shorter than a period has its mean as
    trend and no season; null values count as 0, as elsewhere in a dense panel."""
    ship(panel.sparkSession)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        y = rows["y"].fillna(0.0).to_numpy(float)
        season, level, rho = stl(y, period, **spans) if len(y) >= period else (np.zeros(len(y)), np.full(len(y), y.mean()), np.ones(len(y)))
        return pd.DataFrame({"sku": rows["sku"], "date": rows["date"], "y": y, "season": season, "trend": level, "rest": y - season - level, "weight": rho})

    return panel.select("sku", "date", "y").groupBy("sku").applyInPandas(each, "sku string, date date, y double, season double, trend double, rest double, weight double")
