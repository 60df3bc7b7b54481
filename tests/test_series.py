"""Panels, history features, statistics, forecasters and metrics against plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import diagnostics as D
from tallyloom.operators import history as H
from tallyloom.operators import learned as L
from tallyloom.operators import metrics as M
from tallyloom.operators import panel as P
from tallyloom.operators import post, prep, search
from tallyloom.operators import segment as G
from tallyloom.operators import stats as S
from tallyloom.operators import univariate as U

START = dt.date(2023, 12, 1)
RNG = np.random.default_rng(11)
SERIES = {
    "all_zero": np.zeros(40), "single_sale": np.r_[np.zeros(20), 5.0, np.zeros(19)], "constant": np.full(40, 3.0), "returns": np.round(RNG.normal(1, 4, 40), 2),
    "intermittent": np.where(RNG.random(60) < 0.15, np.round(RNG.random(60) * 20, 2), 0.0), "dense": np.round(RNG.random(60) * 10 + 3 * np.sin(np.arange(60) * 2 * np.pi / 7) + 4, 2), "short": np.array([1.0, 0, 2, 0, 4]),
}


def frame(spark, series):
    rows = [(k, START + dt.timedelta(days=i), float(v)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sku string, date date, y double")


@pytest.fixture(scope="module")
def panel(spark):
    return frame(spark, SERIES).cache()


def future(spark, days=10):
    rows = [(k, START + dt.timedelta(days=len(v) + i), 1.0) for k, v in SERIES.items() for i in range(days)]
    return spark.createDataFrame(rows, "sku string, date date, y double")


def by_sku(df, column):
    out = {}
    for r in df.orderBy("sku", "date").collect():
        out.setdefault(r.sku, []).append(r[column])
    return out


def test_zero_panel_keeps_sums_and_fills(spark):
    sparse = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("b", dt.date(2024, 1, 4), 2.0), (None, dt.date(2024, 1, 2), 9.0)], "family string, date date, v double")
    daily = P.daily_sum(sparse, "family", measure="v")
    out = P.zero_panel(daily)
    assert out.count() == 8 and out.agg(F.sum("y")).first()[0] == 3.0
    assert P.zero_panel(daily.where("false")).count() == 0
    assert P.future_grid(out, 3).count() == 6


def test_lagged_features(panel):
    got = H.lagged(panel).cache()
    for k, values in SERIES.items():
        s = pd.Series(values)
        rows = got.where(F.col("sku") == k).orderBy("date").toPandas()
        for lag in (1, 7, 28):
            assert np.allclose(rows[f"lag_{lag}"], s.shift(lag).fillna(0))
        for w in (7, 28):
            rolled = s.shift(1).rolling(w, min_periods=1)
            assert np.allclose(rows[f"roll_mean_{w}"], rolled.mean().fillna(0)) and np.allclose(rows[f"roll_std_{w}"], rolled.std(ddof=0).fillna(0), atol=1e-6)
            assert np.allclose(rows[f"sale_rate_{w}"], (s > 0).astype(float).shift(1).rolling(w, min_periods=1).mean().fillna(0))
        since, last = [], None
        for i, v in enumerate(values):
            since.append(999 if last is None else i - last)
            last = i if v > 0 else last
        assert rows["days_since_sale"].tolist() == since


def test_no_future_leaks_and_no_other_sku(spark, panel):
    features = [f"lag_{k}" for k in (1, 7, 14, 28)] + ["roll_mean_7", "roll_std_28", "days_since_sale"]
    base = H.lagged(panel).orderBy("sku", "date").select("sku", "date", *features).collect()
    edge = START + dt.timedelta(days=25)
    changed = panel.withColumn("y", F.when((F.col("date") >= edge) | (F.col("sku") == "returns"), F.col("y") * 7 + 1).otherwise(F.col("y")))
    other = H.lagged(changed).orderBy("sku", "date").select("sku", "date", *features).collect()
    assert [a for a in base if a.date <= edge and a.sku != "returns"] == [b for b in other if b.date <= edge and b.sku != "returns"]


def test_exponential_means(panel):
    got = by_sku(H.ewm(panel, {"m": (lambda y: y, 7), "p": (lambda y: F.when(y > 0, y), 14)}), "m")
    gaps = by_sku(H.ewm(panel, {"p": (lambda y: F.when(y > 0, y), 14)}), "p")
    for k, values in SERIES.items():
        s = pd.Series(values)
        assert np.allclose(got[k], s.ewm(span=7, adjust=False).mean().shift(1).fillna(0))
        assert np.allclose(gaps[k], s.where(s > 0).ewm(span=14, adjust=False).mean().shift(1).fillna(0))


def test_statistics(panel):
    zero = {r.sku: r.longest_zero_streak for r in S.longest_zero_run(panel).collect()}
    inter = {r.sku: r for r in S.intermittency(panel).collect()}
    acf = {r.sku: r for r in S.autocorrelation(panel, (1, 7)).collect()}
    for k, values in SERIES.items():
        runs = "".join("0" if v == 0 else "1" for v in values).split("1")
        assert zero[k] == max(map(len, runs))
        at = np.flatnonzero(values > 0)
        assert math.isclose(inter[k].adi, np.diff(at).mean() if len(at) > 1 else len(values))
        a, b = values[1:], values[:-1]
        want = 0.0 if values.std() == 0 or a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
        assert math.isclose(acf[k].acf_1, want, abs_tol=1e-9)
        assert (acf[k].acf_7 is None) == (len(values) <= 7)


def test_numeric_features(panel):
    got = {r.sku: r for r in S.numeric_features(panel).collect()}
    assert abs(got["dense"].dominant_period - 7) < 1 and got["all_zero"].dominant_period is None and got["all_zero"].ljung_box_p == 1.0
    x = SERIES["dense"]
    r1 = ((x - x.mean())[1:] @ (x - x.mean())[:-1]) / ((x - x.mean()) @ (x - x.mean()))
    assert math.isclose(got["dense"].pacf_1, r1) and 0 <= got["dense"].seasonal_strength <= 1 and got["short"].kpss_p is None
    assert math.isclose(S._chi2_above(3.841458820694124, 1), 0.05, abs_tol=1e-9) and math.isclose(S._chi2_above(21.02606981748307, 12), 0.05, abs_tol=1e-9)
    assert S.kpss(np.arange(200.0)) == 0.01 and S.kpss(np.random.default_rng(0).normal(size=300)) > 0.05


def test_segments(spark):
    rows = [(1.0, 0.1, "regular"), (1.32, 9.0, "regular"), (2.0, 0.49, "intermittent"), (2.0, 0.5, "lumpy"), (float("inf"), None, "lumpy")]
    df = spark.createDataFrame(rows, "adi double, cv2 double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", G.segment3(F.col("adi"), F.col("cv2"))).collect())
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert G.rand_index(labels, "a", "b").first().ari == 1.0


def naive(values, n):
    last = values[-7:]
    return [max(last[i - (7 - len(last))], 0.0) if i >= 7 - len(last) else 0.0 for i in (h % 7 for h in range(n))]


def test_forecasters(spark, panel):
    got = by_sku(U.naive7(panel, future(spark)), "pred")
    tsb = {r.sku: r.pred for r in U.tsb_mean(panel).collect()}
    first = {r.sku: r.pred for r in U.tsb_first(panel).collect()}
    blocks = {r.sku: r.pred for r in U.adida(panel).collect()}
    caps = {r.sku: r.cap for r in post.history_cap(panel).collect()}
    for k, values in SERIES.items():
        assert got[k] == naive(values, 10)
        pos = values[values > 0]
        if not len(pos):
            assert tsb[k] == first[k] == caps[k] == 0
            continue
        p, d = min(max((values > 0).mean(), 1e-6), 1), pos.mean()
        q, e = float(values[0] > 0), pos[0]
        for v in values:
            p, q = p + 0.1 * ((v > 0) - p), q + 0.1 * ((v > 0) - q)
            d, e = (d + 0.2 * (v - d), e + 0.2 * (v - e)) if v > 0 else (d, e)
        last = values[-56:][values[-56:] > 0]
        cap = max(0.0, min(max(np.percentile(last, 95), last.mean() * 1.5), last.max() * 1.5))
        assert math.isclose(tsb[k], p * d, rel_tol=1e-9) and math.isclose(caps[k], cap, rel_tol=1e-9) and math.isclose(first[k], min(q * e, cap), rel_tol=1e-9)
        padded = np.r_[np.zeros(-len(values) % 7), values].reshape(-1, 7).sum(1)
        assert math.isclose(blocks[k], max(padded[-4:].mean() / 7, 0), rel_tol=1e-9, abs_tol=1e-12)


def test_routes_and_own_forecasters(spark, panel):
    routes = {r.sku: r.model for r in U.route(panel).collect()}
    assert routes == {"all_zero": "fallback_sparse", "single_sale": "fallback_sparse", "constant": "tsb", "returns": "tsb", "intermittent": routes["intermittent"], "dense": "tsb", "short": "fallback_short"}
    assert U.routed(panel, future(spark)).count() == 70
    own = U.apply_forecaster(panel, lambda v, h: np.full(h, len(v)), 3)
    assert {r.pred for r in own.where("sku = 'dense'").collect()} == {60.0}


def test_smoothing_beats_flat_on_a_season():
    y = 10 + 5 * np.sin(np.arange(140) * 2 * np.pi / 7)
    pred = U.best_smoothing(y[:126], 14)
    assert np.abs(pred - y[126:]).mean() < np.abs(y[:126].mean() - y[126:]).mean() / 2
    assert (U.holt_winters(np.zeros(3), 4)[0] == 0).all() and len(U.holt_winters(np.zeros(0), 4)[0]) == 4


def test_metrics(spark):
    y, p = np.array([0, 0, 2, 4, 0.5, -1, 3]), np.array([0, 1, 2, 1, 0, 0, 5.0])
    rows = [(float(a), float(b)) for a, b in zip(y, p, strict=True)] + [(None, 1.0), (1.0, float("nan")), (float("inf"), 1.0)]
    r = M.scored(spark.createDataFrame(rows, "y double, pred double")).agg(*M.bundle()).first()
    ape = np.abs(y - p) / np.maximum(np.abs(y), 1) * 100
    assert math.isclose(r.EPSILON_MAPE_PCT, ape.mean()) and math.isclose(r.CAP_MAPE_0_100, np.minimum(ape, 100).mean()) and math.isclose(r.POSITIVE_ONLY_MAPE_PCT, ape[y > 0].mean())
    assert math.isclose(r.WMAPE_0_100, np.abs(y - p).sum() / np.abs(y).sum() * 100) and math.isclose(r.RMSE, math.sqrt(((y - p) ** 2).mean()))
    assert math.isclose(r.ZERO_DAY_FPR, 1 / 3) and math.isclose(r.OCCURRENCE_F1, 2 * 3 / (2 * 3 + 1 + 1))
    none = spark.createDataFrame([], "y double, pred double").agg(*M.bundle()).first()
    assert none.MAE is None and none.OCCURRENCE_F1 == 0
    with pytest.raises(ValueError):
        M.bundle(eps=0)
    with pytest.raises(ValueError):
        M.bundle(main="other")


def test_calibration_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.1, 0.0), (0.11, 1.0), (1.0, 1.0), (1.5, 1.0)], "p_sale double, y double")
    assert {(r.bin, r.n) for r in D.calibration(df).collect()} == {(1, 2), (2, 1), (10, 1)}


def test_gates_and_weights(spark):
    df = spark.createDataFrame([(0.1, 10.0), (0.5, 10.0), (0.9, 1000.0)], "p double, s double")
    assert [r.g for r in df.select(post.two_stage(F.col("p"), F.col("s"), cap=F.lit(100.0)).alias("g")).collect()] == [0.0, 4.5, 100.0]
    values = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,), (0.3,), (9.0,)], "v double")
    assert [r.c for r in values.select(post.clean(F.col("v"), 0.5, F.lit(5.0)).alias("c")).collect()] == [0, 0, 0, 0, 5.0]


def step_features(past, day):
    return L.Histories([np.array(past, float)]).features(np.array([0]), pd.DatetimeIndex([day]))[0]


def test_training_and_step_features_agree(panel):
    rows = L.training_rows(panel).where("sku = 'dense'").orderBy("date").collect()
    for t in (0, 1, 8, 40, 59):
        past = SERIES["dense"][:t].tolist()
        want = step_features(past, pd.Timestamp(START) + pd.Timedelta(days=t))
        assert np.allclose([rows[t][c] for c in L.FEATURES], want)


def test_exported_trees_score_like_spark(spark, panel):
    from pyspark.ml.regression import GBTRegressor

    rows = L._vector(L.training_rows(panel))
    model = GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(rows)
    got = model.transform(rows).select("prediction", *L.FEATURES).toPandas()
    assert np.allclose(L.export_trees(model)(got[L.FEATURES].to_numpy(float)), got["prediction"])


def test_recursive_forecasts(spark, panel):
    model = L.fit_two_stage(L.training_rows(panel), trees=3, depth=3, tau=0.3)
    out = L.recursive(panel, future(spark), model)
    rows = out.collect()
    assert len(rows) == 70 and all(r.pred >= 0 and 0 <= r.p_sale <= 1 and (r.p_sale >= 0.3 or r.pred == 0) for r in rows)
    alone = {(r.sku, r.date): r.pred for r in L.recursive(panel.where("sku = 'dense'"), future(spark).where("sku = 'dense'"), model).collect()}
    assert all(alone[(r.sku, r.date)] == r.pred for r in rows if r.sku == "dense")


def test_series_step_together_as_they_do_alone(spark, panel):
    """Batches of any size, with series of several lengths and one without history, give the same forecasts."""
    model = L.fit_two_stage(L.training_rows(panel), trees=3, depth=3, tau=0.1)
    ahead = future(spark).unionByName(future(spark).where("sku = 'dense'").withColumn("sku", F.lit("new")))
    some = panel.where("sku <> 'dense' OR date > '2024-01-20'")
    rows = [{(r.sku, r.date): (r.pred, r.p_sale) for r in L.recursive(some, ahead, model, together=n).collect()} for n in (500, 1)]
    assert rows[0] == rows[1] and any(k[0] == "new" for k in rows[0])


@pytest.mark.parametrize("n, clamped, shrunk", [(1, None, 7), (20, None, 7), (55, None, 11), (56, 18, 11), (57, 19, 42), (125, 41, 42), (300, 42, 42)])
def test_holdouts(spark, n, clamped, shrunk):
    row = spark.range(1).select(P.clamped_holdout(F.lit(n)).alias("a"), P.shrinking_holdout(F.lit(n)).alias("b")).first()
    assert (row.a, row.b) == (clamped, shrunk)


def test_cluster_sweep(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(float(x), float(y)) for c in ((0, 0), (9, 0), (0, 9)) for x, y in rng.normal(c, 0.3, (30, 2))], "x double, y double")
    found = G.sweep(rows, ["x", "y"], range(2, 6)).collect()
    assert [r.k for r in found] == [2, 3, 4, 5] and max(found, key=lambda r: r.silhouette).k == 3 and found[0].inertia > found[1].inertia


def test_analysis_of_methods(spark):
    rows = [("a" if k % 2 else "b", START + dt.timedelta(days=k // 2), float(k % 5), float(k % 3), 1.0, 0.3) for k in range(80)]
    df = spark.createDataFrame(rows, "sku string, date date, y double, pred_one double, pred_two double, p_sale double")
    told = {k: v.collect() for k, v in D.analysis(df, ["pred_one", "pred_two"], "p_sale").items()}
    assert len(told) == 9 and all(told.values()) and {r.method for r in told["methods"]} == {"pred_one", "pred_two"}
    want = 100 * sum(abs(r[2] - r[3]) for r in rows) / sum(r[2] for r in rows)
    assert next(r.wmape for r in told["methods"] if r.method == "pred_one") == pytest.approx(want)
    assert len(told["periods"]) == 8 and sum(r.tp + r.fp + r.fn + r.tn for r in told["confusion"]) == 160 and set(D.evaluate(df, "pred_one")) == set(told) - {"calibration"}
    named = D.labelled_methods(spark.createDataFrame([("pred_one",), ("pred_two_stage",)], "method string"), {"pred_one": "First"})
    assert [r.method for r in named.collect()] == ["First", "Two Stage"]


def test_tables_by_place_and_format(spark, tmp_path):
    from tallyloom.sources import tables as X

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    X.write_table(df, f"{tmp_path}/t.csv")
    assert X.read_first(spark, f"{tmp_path}/t").count() == 2
    X.write_table(df.limit(1), f"{tmp_path}/t.parquet")
    assert X.read_first(spark, f"{tmp_path}/t").count() == 1
    with pytest.raises(FileNotFoundError):
        X.read_first(spark, f"{tmp_path}/none")
    assert [X.located(p, "s3://b/root/") for p in ("a/b", "/a", "file:///a")] == ["s3://b/root/a/b", "/a", "file:///a"]
    assert [r.k for r in X.unfinished(df.union(df), df.where("k = 1"), "k").collect()] == [2]
    X.write_manifest(f"file://{tmp_path}/m/one.json", {"rows": 2})
    assert X.read_manifest(f"{tmp_path}/m/one.json") == {"rows": 2} and X.read_manifest(f"{tmp_path}/m/two.json") == {}
    cache = X.CachedTables(spark, 1)
    one = cache.get(f"{tmp_path}/t.csv", ["v"])
    assert cache.get(f"{tmp_path}/t.csv", ["v"]) is one and one.is_cached and one.columns == ["v"]
    cache.get(f"{tmp_path}/t.parquet")
    assert not one.is_cached and len(cache.held) == 1
    cache.clear()
    assert not cache.held


def test_discarding_intermediate_tables(spark):
    from tallyloom import session

    session.discard(spark)
    out = session.materialize(spark.range(3), "gone")
    assert out.count() == 3 and session.discard(spark) == 1 and session.discard(spark) == 0


def test_count_model(spark, panel):
    counts = panel.withColumn("y", F.greatest(F.round("y"), F.lit(0.0)))
    model = L.fit_counts(L.training_rows(counts), steps=2)
    pred, p = model(np.array([step_features(SERIES["dense"].tolist(), pd.Timestamp(2024, 3, 1)), step_features([0.0] * 60, pd.Timestamp(2024, 3, 1))]))
    assert p[0] > p[1] and pred[0] > pred[1] >= 0 and model.alpha >= 0


def test_search(spark, panel):
    parts = P.fraction_split(panel)
    best = search.search_tsb(parts.where("NOT is_valid"), parts.where("is_valid"), search.grid(spark, {"alpha_p": [0.1, 0.3], "alpha_d": [0.2]})).collect()
    assert len(best) == 2 and best[0].score <= best[1].score
    assert search.grid(spark, {"a": [1, 2, 3], "b": [1, 2]}, draws=4).distinct().count() == 4


def test_prep(spark):
    tx = spark.createDataFrame([("a", " ", 1), ("a", "lamp ", 2), ("a", "light", 3), ("b", None, 4)], "stock_code string, description string, n int")
    assert [(r.stock_code, r.description) for r in prep.fill_descriptions(tx, [F.col("n")]).orderBy("n").collect()] == [("a", "lamp"), ("a", "lamp"), ("a", "light")]
    with pytest.raises(ValueError):
        prep.rename_synonyms(spark.createDataFrame([(1,)], "x int"))
    raw = spark.createDataFrame([("2024-01-01", " a ", "2.5"), ("bad", "a", "1"), ("2024-01-01", "a", "n/a"), ("2024-01-01", "a", "-4")], "Date string, Sales_x string, Sales string").withColumnRenamed("Sales_x", "StockCode")
    assert [(r.sku, r.y) for r in prep.conform_daily(prep.rename_synonyms(raw), clip_negative=True).collect()] == [("a", 2.5)]


def test_every_operator_takes_an_empty_panel(panel):
    none = panel.where("false")
    for out in (H.lagged(none), H.profile(none), S.intermittency(none), S.trend(none), S.peaks(none), U.tsb_mean(none), U.adida(none), U.naive7(none, none), P.weekly_panel(none), S.numeric_features(none), L.training_rows(none)):
        assert out.count() == 0


def test_running_totals(spark):
    from tallyloom.operators.ranking import running_totals

    values = np.random.default_rng(2).integers(-50, 50, 500).astype(float)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double").repartition(5)
    rows = sorted(running_totals(df, [F.desc("v"), F.asc("k")], "v").collect(), key=lambda r: r["rank"])
    order = sorted(range(500), key=lambda k: (-values[k], k))
    assert [r.k for r in rows] == order and [r["rank"] for r in rows] == list(range(1, 501))
    assert np.allclose([r.running for r in rows], values[order].cumsum()) and {r.total for r in rows} == {values.sum()}
    assert running_totals(df.where("false"), ["k"], "v").count() == 0
