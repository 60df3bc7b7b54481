"""The smoothing family against a plain recursion, the search against a grid, the competition on made series."""

import datetime
import itertools

import numpy as np
import pytest

from tallyloom.operators import smoothing as M


def plain(x, model, alpha, beta, gamma, phi, horizon):
    """One series, one value at a time."""
    level, slope, season = (c[0] for c in M.beginning(x[None], model))
    season, error, m = list(np.atleast_1d(season)), 0.0, model.period if model.seasonal else 1

    def ahead(reach):
        return level if not model.trend else level * slope**reach if model.trend == "mul" else level + reach * slope

    for t, value in enumerate(x):
        base, s = ahead(phi), season[t % m]
        error += (value - (base * s if model.seasonal == "mul" else base + s if model.seasonal else base)) ** 2
        new = alpha * (value / s if model.seasonal == "mul" else value - s if model.seasonal else value) + (1 - alpha) * base
        if model.trend == "mul":
            slope = beta * new / level + (1 - beta) * slope**phi
        elif model.trend:
            slope = beta * (new - level) + (1 - beta) * phi * slope
        level = new
        if model.seasonal:
            season[t % m] = gamma * (value / base if model.seasonal == "mul" else value - base) + (1 - gamma) * s
    out = []
    for h in range(1, horizon + 1):
        base, s = ahead(sum(phi**k for k in range(1, h + 1))), season[(len(x) + h - 1) % m]
        out.append(base * s if model.seasonal == "mul" else base + s if model.seasonal else base)
    return error, out


@pytest.mark.parametrize("model", [M.Model(t, s, d) for t, s, d in itertools.product((None, "add", "mul"), (None, "add", "mul"), (False, True)) if t or not d], ids=lambda m: m.name)
def test_recursion_equals_the_plain_one(model):
    draw = np.random.default_rng(1)
    x = 5 + 0.02 * np.arange(60) + np.sin(2 * np.pi * np.arange(60) / 7) + draw.normal(0, 0.2, (3, 60))
    trials = np.array([[0.2, 0.1, 0.3, 0.9], [0.6, 0.05, 0.1, 0.97]])
    params = [np.tile(trials[:, k] if n in model.free else (1.0 if n == "phi" else 0.0), (3, 1)) for k, n in enumerate(("alpha", "beta", "gamma", "phi"))]
    params = [np.broadcast_to(p, (3, 2)).copy() for p in params]
    sse, out = M.run(x, model, *params, 10)
    for r in range(3):
        for k in range(2):
            want = plain(x[r], model, *(p[r, k] for p in params), 10)
            assert np.isclose(sse[r, k], want[0]) and np.allclose(out[r, k], want[1])


def test_simplex_finds_each_rows_least():
    goals = np.array([[0.2, 0.7], [0.9, 0.1], [2.0, -1.0]])
    best, cost = M.simplex(lambda p: ((p - goals[:, None]) ** 2 * [1, 10]).sum(-1), np.full((3, 2), 0.5), np.zeros(2), np.ones(2), 200)
    assert np.allclose(best, np.clip(goals, 0, 1), atol=1e-3) and np.allclose(cost, ((best - goals) ** 2 * [1, 10]).sum(-1))


def test_fit_is_no_worse_than_a_grid():
    draw = np.random.default_rng(7)
    y = np.maximum(0, 20 + 5 * np.sin(2 * np.pi * np.arange(120) / 7) + draw.normal(0, 3, (4, 120)))
    for model in (M.Model(), M.Model("add", damped=True), M.Model(None, "add"), M.Model("add", "mul", True)):
        grid = np.array(list(itertools.product(*[np.linspace(M.LOW[n], M.HIGH[n], 6) for n in model.free])))
        own = [np.tile(grid[:, model.free.index(n)] if n in model.free else np.full(len(grid), 1.0 if n == "phi" else 0.0), (4, 1)) for n in ("alpha", "beta", "gamma", "phi")]
        least = M.run(model.forward(y), model, *own)[0].min(1)
        assert (M.fit(y, model, steps=150)["sse"] <= least * 1.02).all(), model.name


def test_competition(spark):
    """A season chooses a seasonal model, a line a trend; short series and null days have defined results."""
    draw, day, n = np.random.default_rng(3), datetime.date(2024, 1, 1), 84
    t = np.arange(n)
    made = {"season": 30 + 20 * np.sin(2 * np.pi * t / 7) + draw.normal(0, 0.5, n), "line": 5 + 3.0 * t, "none": np.zeros(n), "short": np.ones(10), "mid": np.ones(20)}
    rows = [(s, day + datetime.timedelta(k), float(v) if (s, k) != ("none", 3) else None, "x") for s, y in made.items() for k, v in enumerate(y)]
    panel = spark.createDataFrame(rows, "sku string, date date, y double, model string").repartition(3)
    models = [M.Model(log=False), M.Model("add", log=False), M.Model(None, "add", log=False), M.Model("add", "add", True, log=False)]
    got = {r.sku: r for r in M.chosen(panel, 7, models).collect()}
    assert set(got) == {"season", "line", "none", "mid"} and got["mid"].tried == 2
    assert got["season"].model in ("none_add7_raw", "add_damped_add7_raw") and np.allclose(got["season"].forecast, 30 + 20 * np.sin(2 * np.pi * np.arange(n, n + 7) / 7), atol=2.5)
    assert got["line"].model == "add_raw" and np.allclose(got["line"].forecast, 5 + 3.0 * np.arange(n, n + 7), rtol=1e-3) and got["line"].sse < 1
    assert got["none"].forecast == [0.0] * 7 and got["none"].score == 0.0 and got["none"].model == "ses_raw"
    one = M.fit(made["season"][None], models[[m.name for m in models].index(got["season"].model)], 7)
    assert np.allclose(one["forecast"][0], got["season"].forecast) and np.isclose(one["sse"][0], got["season"].sse)
    table = M.parameters(panel, models[:2]).collect()
    assert len(table) == 10 and all(0 <= r.alpha <= 1 and abs(r.resid_var - r.sse / r.n) < 1e-12 for r in table)
    assert M.chosen(panel.limit(0), 7, models).count() == 0
