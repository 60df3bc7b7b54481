"""STL against its definition, written out point by point; the unit-root test against known values and plain least squares."""

import math

import numpy as np
import pytest

from tallyloom.operators import decomposition as D
from tallyloom.operators import unitroot as R


def one_loess(y, span, rho, at):
    """Local linear regression at one place (from 1), as the paper states it: the span nearest points, tricube, weighted line."""
    n = len(y)
    half = (span + 1) // 2
    left = 1 if span >= n else min(max(1, at - half + 1), n - span + 1)
    right = n if span >= n else left + span - 1
    reach = max(at - left, right - at) + (max(0, span - n) // 2)
    pairs = []
    for j in range(left, right + 1):
        r = abs(j - at)
        if r <= 0.999 * reach:
            pairs.append((j, (1.0 if r <= 0.001 * reach else (1 - (r / reach) ** 3) ** 3) * rho[j - 1]))
    total = sum(w for _, w in pairs)
    if total <= 0:
        return y[min(max(at, 1), n) - 1]
    mean = sum(w * j for j, w in pairs) / total
    spread = sum(w * (j - mean) ** 2 for j, w in pairs) / total
    slope = math.sqrt(spread) > 0.001 * (n - 1)
    return sum(w / total * (1 + ((at - mean) * (j - mean) / spread if slope else 0)) * y[j - 1] for j, w in pairs)


def plain_stl(y, period, outer):
    n, trend_span, low_span = len(y), D.odd(1.5 * period / (1 - 1.5 / 7)), D.odd(period + 1)
    season, trend, rho = [0.0] * n, [0.0] * n, [1.0] * n
    for k in range(outer + 1):
        for _ in range(2):
            free = [a - b for a, b in zip(y, trend, strict=True)]
            cycle = [0.0] * (n + 2 * period)
            for s in range(period):
                own, weights = free[s::period], rho[s::period]
                for m in range(len(own) + 2):
                    cycle[s + m * period] = one_loess(own, 7, weights, m)
            mean = lambda x, w: [sum(x[i : i + w]) / w for i in range(len(x) - w + 1)]
            passed = mean(mean(mean(cycle, period), period), 3)
            low = [one_loess(passed, low_span, [1.0] * n, i + 1) for i in range(n)]
            season = [cycle[period + i] - low[i] for i in range(n)]
            rest = [a - b for a, b in zip(y, season, strict=True)]
            trend = [one_loess(rest, trend_span, rho, i + 1) for i in range(n)]
        if k < outer:
            rest = [abs(a - b - c) for a, b, c in zip(y, season, trend, strict=True)]
            bound = 6 * float(np.median(rest))
            rho = [1.0 if r <= 0.001 * bound or bound <= 1e-12 * max(map(abs, y)) else (1 - (r / bound) ** 2) ** 2 if r <= 0.999 * bound else 0.0 for r in rest]
    return season, trend, rho


@pytest.mark.parametrize(("n", "period", "outer"), [(60, 7, 15), (29, 7, 3), (15, 7, 2), (110, 52, 2), (60, 52, 1), (40, 4, 15)])
def test_equals_the_definition(n, period, outer):
    draw = np.random.default_rng(n + period)
    y = 5 + 0.1 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / period) + draw.gamma(0.4, 4, n)
    got, want = D.stl(y, period, outer=outer), plain_stl(y.tolist(), period, outer)
    for a, b in zip(got, want, strict=True):
        assert np.allclose(a, b, atol=1e-6)


def test_hand_made_fixture():
    """A line and a fixed season are parted exactly, and peaks on top of them are left to the rest."""
    t = np.arange(70)
    season = np.array([3.0, -1, 0, 2, -4, 1, -1])[t % 7]
    got = D.stl(10 + 0.5 * t + season, 7)
    assert np.allclose(got[0], season, atol=1e-6) and np.allclose(got[1], 10 + 0.5 * t, atol=1e-6)
    peaks = np.zeros(70)
    peaks[[20, 41]] = 500
    robust, weak = D.stl(10 + 0.5 * t + season + peaks, 7), D.stl(10 + 0.5 * t + season + peaks, 7, outer=0)
    assert np.abs(robust[0] - season).max() < 0.02 < 1 < np.abs(weak[0] - season).max()
    assert (robust[2][[20, 41]] == 0).all()


def test_batches_equal_single_series(monkeypatch):
    y = np.random.default_rng(0).gamma(1, 3, (3, 5, 50))
    whole = D.stl(y, 7)
    monkeypatch.setattr(D, "WINDOWS", 2000)
    parts = D.stl(y, 7)
    for a, b in zip(whole, parts, strict=True):
        assert np.allclose(a, b)
        assert np.allclose(a[1, 2], D.stl(y[1, 2], 7)[[*map(id, whole)].index(id(a))])


def test_strength_of_edge_series():
    t = np.arange(60)
    assert D.strength(np.sin(2 * np.pi * t / 7), 7) > 0.999
    assert D.strength(np.zeros(60), 7) == 0.0 == D.strength(np.full(60, 4.0), 7)
    assert D.strength(np.ones(13), 7) is None and D.strength(np.ones(14), 7) is not None
    assert D.strength(np.random.default_rng(2).normal(size=400), 7) < 0.3
    with pytest.raises(ValueError, match="period"):
        D.stl(np.ones(5), 7)


def test_components_of_a_panel(spark):
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [("a", day + datetime.timedelta(t), float(t % 7), "x") for t in range(35)] + [("b", day, 2.0, "x"), ("b", day + datetime.timedelta(1), None, "x")]
    panel = spark.createDataFrame(rows, "sku string, date date, y double, season string").repartition(3)
    got = {(r.sku, r.date): r for r in D.components(panel).collect()}
    assert len(got) == 37 and all(abs(r.season + r.trend + r.rest - r.y) < 1e-9 for r in got.values())
    assert got[("b", day)].trend == 1.0 and got[("b", day)].season == 0.0
    assert abs(got[("a", day)].season + 3) < 1e-6
    assert D.components(panel.limit(0)).count() == 0


def plain_adf(y, most):
    """Every regression for itself, by its definition."""

    def fit(k, rows):
        step = np.diff(y)
        own = list(range(len(step)))[-rows:]
        x = np.array([[1.0, y[t], *(step[t - j] for j in range(1, k + 1))] for t in own])
        beta, *_ = np.linalg.lstsq(x, step[own], rcond=None)
        left = step[own] - x @ beta
        return x, beta, left @ left

    n = len(y) - 1 - most
    best = min(range(most + 1), key=lambda k: n * math.log(fit(k, n)[2] / n) + 2 * (k + 2))
    x, beta, left = fit(best, len(y) - 1 - best)
    return beta[1] / math.sqrt(left / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), best


def test_unit_root_test():
    draw = np.random.default_rng(5)
    noise = draw.normal(size=300)
    walk, still = noise.cumsum(), noise.copy()
    for t in range(1, 300):
        still[t] += 0.5 * still[t - 1]
    for y in (walk, still, noise, draw.poisson(0.3, 60).astype(float), np.abs(walk[:25])):
        stat, p, lags = R.adf(y)
        want, k = plain_adf(y, min(7, (len(y) - 1) // 2 - 2))
        assert abs(stat - want) < 1e-8 and lags == k and p == R.p_value(stat)
    assert R.adf(walk)[1] > 0.1 and R.adf(still)[1] < 1e-6
    assert R.adf(np.ones(50)) == (None, None, None) == R.adf(noise[:19])


@pytest.mark.parametrize(("statistic", "p"), [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-1.94, 0.3139), (-0.44, 0.90), (3.0, 1.0), (-20.0, 0.0)])
def test_known_quantiles(statistic, p):
    """Quantiles of the distribution with a constant, from the published tables."""
    assert abs(R.p_value(statistic) - p) < 0.005
