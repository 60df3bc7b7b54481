"""Searches: scores against plain Python, shared runs against single ones, losses and edge cases."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import learned as L
from tallyloom.operators import tuning as T

DAY = datetime.date(2024, 1, 1)


def panel(spark, days=120, skus=4):
    draw = np.random.default_rng(4)
    rows = [(f"s{k}", DAY + datetime.timedelta(d), float(draw.integers(1, 9) * (k + 1)) if draw.random() < (0.8 if (DAY + datetime.timedelta(d)).weekday() < 5 else 0.2) else 0.0, "x") for k in range(skus) for d in range(days)]
    return spark.createDataFrame(rows, "sku string, date date, y double, candidate string")


def plain_objectives(rows, early):
    edge = sorted({d for d, _, _ in rows})[:early][-1]
    soon = [(y, p) for d, y, p in rows if d <= edge]
    ape = lambda y, p: abs(y - p) / max(abs(y), 1) * 100
    mean = lambda v: sum(v) / len(v) if v else 0.0
    wm = lambda v: sum(abs(y - p) for y, p in v) / max(sum(abs(y) for y, _ in v), 1) * 100
    every = [(y, p) for _, y, p in rows]
    a, p = (np.array([sum(r[k] for r in rows if r[0] == d) for d in sorted({d for d, _, _ in rows})]) for k in (1, 2))
    short = lambda least, u, v: max(0.0, least - np.std(u) / max(np.std(v), 1))
    zero = [(y, q) for y, q in every if y <= 0]
    return {
        "mape": mean([min(ape(*v), 100) for v in every]), "wmape": wm(every), "early_mape": mean([min(ape(*v), 100) for v in soon]), "early_wmape": wm(soon),
        "early_under": mean([max(y - q, 0) / max(y, 1) * 100 for y, q in soon if y > 0]), "fpr_pct": 100 * mean([q > 0 for _, q in zero]),
        "positive_mape": mean([ape(y, q) for y, q in every if y > 0]), "pred_rate": mean([q > 0 for _, q in every]), "actual_rate": mean([y > 0 for y, _ in every]),
        "flatness": 100 * (short(0.45, p, a) + 1.25 * (short(0.5, np.diff(p), np.diff(a)) if len(a) > 1 else 0.0)),
    }


@pytest.mark.parametrize("days", [1, 9])
def test_objectives_by_definition(spark, days):
    draw = np.random.default_rng(2)
    rows = [(c, DAY + datetime.timedelta(d), float(draw.integers(0, 3) * 4), float(draw.integers(0, 3) * (4 if c else 1))) for c in (0, 1) for d in range(days) for _ in range(5)]
    df = spark.createDataFrame([*rows, (0, DAY, None, 5.0), (1, DAY, float("nan"), 5.0)], "candidate int, date date, y double, pred double").repartition(3)
    got = {r.candidate: r.asDict() for r in T.objectives(df, early=3).collect()}
    for c in (0, 1):
        for name, value in plain_objectives([r[1:] for r in rows if r[0] == c], 3).items():
            assert got[c][name] == pytest.approx(value, abs=1e-9), (c, name)
    assert T.objectives(df.limit(0)).count() == 0


def test_scores_weigh_as_stated(spark):
    one = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, False)], "wmape double, mape double, early_wmape double, early_mape double, early_under double, fpr_pct double, flatness double, positive_mape double, fitted boolean")
    got = one.select(T.count_score(), T.count_score("mape"), T.two_stage_score(), T.two_stage_score("mape"), T.global_score()).first()
    assert list(got) == pytest.approx([6 + 7.5 + 7.5 + 25, 12 + 10 + 7.5 + 25, 10 + 12 + 21, 20 + 21 + 21, 7 + 16 + 0.06])
    with pytest.raises(ValueError, match="goal"):
        T.count_score("rmse")


def test_models_together_equal_models_alone(spark):
    df = panel(spark)
    train, future = df.where("date < '2024-04-01'"), df.where("date >= '2024-04-01'")
    rows = L.training_rows(train)
    fitted = L.fit_two_stage(rows, trees=3, depth=2, tau=0.3)
    models = [fitted, L.fit_counts(rows, steps=5), lambda x: (x[:, 0] / 2, np.ones(len(x)))]
    both = {(r.sku, r.date): r.preds for r in L.recursive_each(train, future, models, together=2).collect()}
    for k, model in enumerate(models):
        alone = L.recursive(train, future, model).collect()
        assert len(alone) == len(both) and all(both[r.sku, r.date][k] == pytest.approx(r.pred, abs=1e-9) for r in alone)


@pytest.mark.parametrize("loss", L.LOSSES)
def test_losses_of_the_global_model(spark, loss):
    df = panel(spark, days=100)
    rows = L.training_rows(df)
    model = L.fit_global(rows, trees=5, depth=3, loss=loss, cap=11.0)
    x = np.array([[r[c] for c in L.FEATURES] for r in rows.collect()], float)
    y = np.array([r.y for r in rows.collect()])
    pred, p = model(x)
    assert (pred >= -1e-9).all() and pred.max() <= 11.0 and (p == 1).all()
    assert np.corrcoef(pred, y)[0, 1] > 0.4
    # each is better by its own measure than the best constant
    target, own = np.log1p(y), np.log1p(L.fit_global(rows, trees=5, depth=3, loss=loss)(x)[0])
    if loss == "absolute":
        assert np.abs(target - own).mean() < np.abs(target - np.median(target)).mean()
    elif loss == "squared":
        assert ((target - own) ** 2).mean() < target.var()
    else:
        assert (own - target * np.log(np.maximum(own, 1e-9))).mean() < target.mean() - target.mean() * math.log(target.mean())
    with pytest.raises(ValueError, match="loss"):
        L.fit_global(rows, loss="hinge")


def test_log_links_meet_their_estimating_equations(spark):
    rows = L.training_rows(panel(spark, days=100))
    x = np.array([[r[c] for c in L.FEATURES] for r in rows.collect()], float)
    target = np.log1p(np.array([r.y for r in rows.collect()]))
    for loss, power in (("poisson", 1.0), ("tweedie", 1.5)):
        model = L.fit_global(rows, loss=loss)
        z = model.design.values(x)
        mean = np.exp(z @ model.weights)
        assert np.abs(z.T @ ((target - mean) * mean ** (1 - power)) / len(x)).max() < 1e-3


def test_staged_search_reuses_one_table(spark):
    trail = T.staged_search(panel(spark), [{"trees": 2, "depth": 2}, {"trees": 4, "depth": 2, "leaf": 5}], [{"trees": 2, "depth": 2}, {"trees": 3, "depth": 2}]).toPandas()
    assert len(trail[trail.stage == "occurrence"]) == 2 * len(T.TAUS)
    assert len(trail[trail.stage == "size"]) == 2 * len(T.ALPHAS) * len(T.CAP_QS) * math.prod(map(len, T.PENALTIES.values()))
    best = trail[trail.is_best].set_index("stage")
    assert len(best) == 2 and all(best.score[s] <= trail[trail.stage == s].score.min() + 1e-6 for s in best.index)
    assert (trail[trail.stage == "size"][["occurrence", "tau"]] == best.loc["occurrence", ["occurrence", "tau"]].to_numpy()).all().all()


def test_tuning_trails(spark):
    df = panel(spark)
    got = T.tune_counts(df, days=21, steps=4).toPandas()
    assert set(got.tau) == {0.4, 0.5} and got.fitted.all() and got.is_best.sum() == 1 and got[got.is_best].score.iloc[0] == pytest.approx(got.score.min(), abs=1e-6)
    got = T.tune_two_stage(df, days=21, fits=({"trees": 2, "depth": 2},)).toPandas()
    assert len(got) == 4 and (got.score.round(9) == (got.wmape + 0.2 * got.fpr_pct + 0.3 * got.flatness).round(9)).all()
    got = T.search_global(df, 3, {"loss": list(L.LOSSES), "trees": [2], "depth": [2], "cap_q": [0.98, 0.995], "recent": [2.0]}).toPandas()
    assert len(got) == 3 and not got.duplicated(["loss", "cap_q"]).any()


def test_searches_without_sales_or_rows(spark):
    still = panel(spark, days=60, skus=2).withColumn("y", F.lit(0.0))
    trail = T.staged_search(still, [{}], [{}])
    assert {r.stage for r in trail.where("is_best").collect()} == {"occurrence", "size"}
    assert T.staged_search(still.limit(0), [{}], [{}]).count() == 0
    assert T.tune_two_stage(still, days=14).where("is_best").first().score == pytest.approx(0.3 * 100 * (0.45 + 1.25 * 0.5))  # as flat as can be
    assert T.concurrently([lambda k=k: k * k for k in range(7)]) == [k * k for k in range(7)]
