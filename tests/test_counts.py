"""Zero-inflated counts: the likelihood by definition, its derivatives by differences, the fit against a plain one and against made data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import counts as C
from tallyloom.operators.design import UNSEEN, Design


def plain(n, eta, zeta, theta):
    mu, pi = math.exp(eta), 1 / (1 + math.exp(-zeta))
    if theta is None:
        own = math.exp(n * math.log(mu) - mu - math.lgamma(n + 1))
    else:
        r = math.exp(-theta)
        own = math.exp(math.lgamma(n + r) - math.lgamma(r) - math.lgamma(n + 1) + r * math.log(r / (r + mu)) + n * math.log(mu / (r + mu)))
    return math.log((pi if n == 0 else 0) + (1 - pi) * own)


@pytest.mark.parametrize("theta", [None, -2.0, 0.3, 1.5])
def test_likelihood_and_derivatives(theta):
    draw = np.random.default_rng(1)
    n, eta, zeta = draw.poisson(2, 40).astype(float) * draw.integers(0, 2, 40), draw.normal(0, 1, 40), draw.normal(0, 1, 40)
    value, first = C.slopes(n, eta, zeta, theta)
    assert np.allclose(value, [plain(*v, theta) for v in zip(n, eta, zeta, strict=True)])
    h = 1e-6
    assert np.allclose(first[:, 0], (C.slopes(n, eta + h, zeta, theta)[0] - C.slopes(n, eta - h, zeta, theta)[0]) / (2 * h), atol=1e-5)
    assert np.allclose(first[:, 1], (C.slopes(n, eta, zeta + h, theta)[0] - C.slopes(n, eta, zeta - h, theta)[0]) / (2 * h), atol=1e-5)
    if theta is not None:
        assert np.allclose(first[:, 2], (C.slopes(n, eta, zeta, theta + h)[0] - C.slopes(n, eta, zeta, theta - h)[0]) / (2 * h), atol=1e-5)


def made(rows=4000, alpha=0.8):
    draw = np.random.default_rng(9)
    a, b = draw.normal(10, 3, rows), draw.normal(0, 1, rows)
    mu, pi = np.exp(0.9 + 0.6 * (a - 10) / 3 - 0.3 * b), 1 / (1 + np.exp(-(-0.8 + 0.9 * b)))
    n = draw.poisson(draw.gamma(1 / alpha, alpha * mu) if alpha else mu) * (draw.random(rows) > pi)
    return a, b, n


@pytest.mark.parametrize(("distribution", "alpha"), [("zip", 0.0), ("zinb", 0.8)])
def test_fit_equals_a_plain_one(spark, distribution, alpha):
    a, b, n = made(alpha=alpha)
    df = spark.createDataFrame([(float(x), float(y), float(k), "extra") for x, y, k in zip(a, b, n, strict=True)], "a double, b double, y double, n string").repartition(5)
    model = C.fit(df, ["a", "b"], distribution=distribution, cap=1000.0)
    z = np.column_stack([np.ones(len(a)), (a - a.mean()) / a.std(), (b - b.mean()) / b.std()])
    z[:, 1:] = np.clip(z[:, 1:], -6, 6)
    theta = (lambda w: float(w[6])) if alpha else (lambda w: None)
    best, trail = C.maximise(lambda w: C.sums(z, z, n.astype(float), w[:3], w[3:6], theta(w)), np.r_[0.5, 0, 0, 0, 0, 0, [0.0] * (alpha > 0)])
    assert all(y > x for x, y in zip(model.trail, model.trail[1:], strict=False)), "the likelihood never falls"
    assert abs(model.trail[-1] - trail[-1]) < 1e-4 * abs(trail[-1])
    assert np.allclose(np.r_[model.mean, model.inflation], best[:6], atol=2e-3)
    # a maximum: gradient 0, and near what the data were made of
    assert np.abs(C.sums(z, z, n.astype(float), model.mean, model.inflation, math.log(model.alpha) if alpha else None)[1]).max() < 1.0
    assert np.allclose(model.mean, [0.9, 0.6, -0.3], atol=0.12) and np.allclose(model.inflation, [-0.8, 0, 0.9], atol=0.3) and abs(model.alpha - alpha) < 0.2


def test_dispersion_raises_the_likelihood_of_overdispersed_counts(spark):
    a, b, n = made(1500)
    df = spark.createDataFrame([(float(x), float(y), float(k)) for x, y, k in zip(a, b, n, strict=True)], "a double, b double, y double")
    assert C.fit(df, ["a"], ["b"]).trail[-1] > C.fit(df, ["a"], ["b"], distribution="zip").trail[-1] + 10


def test_defined_results_of_degenerate_tables(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (None, None, None), (float("nan"), None, -3.0)], "a double, b double, y double")
    for rows in (df, df.limit(0)):
        model = C.fit(rows, ["a", "b"])
        pred, p = model(np.array([[1.0, np.nan], [np.nan, 2.0]]))
        assert (pred == 0).all() and np.isfinite(p).all()
    with pytest.raises(ValueError, match="distribution"):
        C.fit(df, ["a"], distribution="normal")


def test_design_is_frozen(spark):
    train = spark.createDataFrame([(1.0, "a", 5), (3.0, "b", 5), (None, None, 5)], "v double, c string, k int")
    own = Design.fit(train, ["v", "k"], ["c"])
    later = spark.createDataFrame([(3.0, "b", 5), (99.0, "new", None), (None, None, 6), (float("nan"), "a", 5)], "v double, c string, k int")
    got = [(r.const, r.z_v, r.z_k, r.code_c) for r in own.matrix(later, []).collect()]
    assert got == [(1.0, 1.0, 0.0, 1), (1.0, 6.0, 0.0, UNSEEN), (1.0, 0.0, 1.0, UNSEEN), (1.0, 0.0, 0.0, 0)]
    rows = np.array([[3.0, 5], [99, np.nan], [np.nan, 6], [np.nan, 5]])
    assert np.allclose(own.values(rows), [x[:3] for x in got])
    assert [list(r[0]) for r in later.select(own.row(["k"])).collect()] == [[1.0, x[2]] for x in got]
    with pytest.raises(ValueError, match="levels"):
        Design.fit(train, ["v"], ["c"], most_levels=1)
    assert Design.fit(train.limit(0), ["v"], ["c"]).matrix(later, ["v"]).select(F.max("code_c")).first()[0] == UNSEEN
