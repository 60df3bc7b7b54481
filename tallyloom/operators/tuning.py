"""Searches over fitted models. Fits run concurrently over one written table; all candidates forecast in one job, whose rows carry an array of
forecasts; objectives are aggregates by candidate, combined from partial sums; only the trail of scores (a row per candidate) is small.

Defined results: rows whose actual value is null or NaN don't count; rates and errors over no rows are 0; without held-out rows a trail is empty; of
equal scores (to six places) the first candidate wins. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import learned as L
from tallyloom.operators import metrics as M
from tallyloom.operators import post
from tallyloom.operators.panel import fraction_split, last_days_split
from tallyloom.operators.search import combinations, grid
from tallyloom.session import materialize, ship

#: Decisions and penalties of the staged search. Fixed values.
TAUS, ALPHAS, CAP_QS = (0.30, 0.40, 0.45, 0.55), (0.95, 1.0, 1.1, 1.2), (0.95, 0.98, 0.995)
PENALTIES = {"lambda_fp": (1.0, 5.0, 10.0), "lambda_over": (0.01, 0.05, 0.10), "lambda_recall": (5.0, 10.0)}
#: Days of a hold-out that count as early, and what a failed fit costs. Fixed values.
EARLY, FAILED = 14, 25.0
#: Fits at a time; places to which scores are compared, as sums in another order differ beyond.
TOGETHER, PLACES = 3, 6

T = TypeVar("T")


def concurrently(makers: list[Callable[[], T]], together: int = TOGETHER) -> list[T]:
    """Results in order; so many run at a time, each as Spark jobs of its own."""
    with ThreadPoolExecutor(together) as pool:
        return list(pool.map(lambda make: make(), makers))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# the staged search


def score_stages(rows: DataFrame, occurs: list[Callable[[np.ndarray], np.ndarray]], sizes: list[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """sku, date, y, ps and sizes: probabilities and sizes by every model, in one pass over rows of features."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            x = batch[L.FEATURES].to_numpy(float)
            ps, each = (np.stack([f(x) for f in models], 1) for models in (occurs, sizes))
            yield pd.DataFrame({"sku": batch["sku"], "date": batch["date"], "y": batch["y"], "ps": list(ps), "sizes": list(each)})

    return rows.mapInPandas(run, "sku string, date date, y double, ps array<double>, sizes array<double>")


def occurrence_scores(scored: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """occurrence (a model's place), tau, recall, fpr, rates of forecast and actual sale days, and score: the gap of rates + 0.8 fpr + 0.4 of what recall lacks."""
    each = M.scored(scored, "y", "y").select("y", F.posexplode("ps").alias("occurrence", "p")).crossJoin(F.broadcast(grid(scored.sparkSession, {"tau": list(taus)}).drop("candidate")))
    y, sells = F.col("y"), (F.col("p") >= F.col("tau")).cast("double")
    out = each.groupBy("occurrence", "tau").agg(M.recall(y, sells).alias("recall"), _zero(M.false_positive_rate(y, sells)).alias("fpr"), F.avg(sells).alias("pred_rate"), F.avg((y > 0).cast("double")).alias("actual_rate"))
    return out.withColumn("score", F.abs(F.col("pred_rate") - F.col("actual_rate")) + 0.8 * F.col("fpr") + 0.4 * (1 - F.col("recall")))


def best(trail: DataFrame, *order: str) -> DataFrame:
    """One row: the least score; of equal ones the first by order."""
    return trail.orderBy(F.round("score", PLACES), *order).limit(1)


def caps_by_quantile(train: DataFrame, qs: tuple[float, ...] = CAP_QS) -> DataFrame:
    """cap_q, cap: quantiles of all positive values, infinite without any; one aggregate."""
    one = train.agg(F.percentile(F.when(F.col("y") > 0, F.col("y")), list(qs)).alias("caps"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(q).alias("cap_q"), F.coalesce(F.get("caps", F.lit(k)), F.lit(float("inf"))).alias("cap")) for k, q in enumerate(qs)])).alias("c")).select("c.*")


def size_scores(scored: DataFrame, chosen: DataFrame, caps: DataFrame, alphas: tuple[float, ...] = ALPHAS, penalties: dict[str, tuple[float, ...]] = PENALTIES, eps: float = 1.0) -> DataFrame:
    """The second stage: with the chosen (one row) occurrence and tau, every size model, alpha, cap and set of penalties, and its score."""
    spark, finite = scored.sparkSession, M.scored(scored, "y", "y")
    usual = F.broadcast(finite.agg(F.greatest(_zero(F.percentile(F.when(F.col("y") > 0, F.col("y")), 0.5)), F.lit(eps)).alias("usual")))  # one row
    gate = F.broadcast(chosen.select("occurrence", "tau"))  # one row
    each = finite.crossJoin(gate).select("y", "tau", F.get("ps", "occurrence").alias("p"), F.posexplode("sizes").alias("size_model", "size"))
    each = each.crossJoin(F.broadcast(grid(spark, {"alpha": list(alphas)}).drop("candidate"))).crossJoin(F.broadcast(caps))  # a row per quantile
    y, pred = F.col("y"), F.col("pred")
    rows = each.select("y", "size_model", "alpha", "cap_q", "cap", post.two_stage(F.col("p"), F.col("size"), F.col("tau"), F.col("alpha"), F.col("cap")).alias("pred"))
    told = rows.groupBy("size_model", "alpha", "cap_q", "cap").agg(
        M.wmape(y, pred, eps).alias("wmape"),
        _zero(F.avg(F.when(y > 0, M.ape(y, pred, eps)))).alias("positive_mape"),
        _zero(M.false_positive_rate(y, pred)).alias("fpr"),
        _zero(F.avg(F.when((y <= 0) & (pred > 0), pred))).alias("over"),
        M.recall(y, pred).alias("recall"),
        F.avg((pred > 0).cast("double")).alias("pred_rate"),
        F.avg((y > 0).cast("double")).alias("actual_rate"),
    )
    told = told.crossJoin(usual).withColumn("over", F.col("over") / F.col("usual") * 100.0).drop("usual").crossJoin(gate)
    weighed = told.crossJoin(F.broadcast(grid(spark, {k: list(v) for k, v in penalties.items()}).drop("candidate")))
    gap = F.abs(F.col("pred_rate") - F.col("actual_rate"))
    score = 0.6 * F.col("wmape") + 0.4 * F.col("positive_mape") + F.col("lambda_fp") * F.col("fpr") + 0.1 * F.col("lambda_over") * F.col("over") + 100.0 * F.col("lambda_recall") * (1 - F.col("recall")) + 3000.0 * gap
    return weighed.withColumn("score", score)


def stages(scored: DataFrame, train: DataFrame, **grids) -> DataFrame:
    """The trail of both stages over one table of score_stages(): stage, the settings, measures and score, and is_best, true for one row of each stage."""
    first = materialize(occurrence_scores(scored, grids.pop("taus", TAUS)), "occurrence-scores")
    second = size_scores(scored, best(first, "occurrence", "tau"), caps_by_quantile(train, grids.pop("cap_qs", CAP_QS)), **grids)
    trail = first.withColumn("stage", F.lit("occurrence")).unionByName(second.withColumn("stage", F.lit("size")), allowMissingColumns=True)
    order = Window.partitionBy("stage").orderBy(F.round("score", PLACES), "occurrence", "tau", "size_model", "alpha", "cap_q", *PENALTIES)  # a row per candidate
    return trail.withColumn("is_best", F.row_number().over(order) == 1)


def staged_search(panel: DataFrame, occurrence: list[dict], size: list[dict], fraction: float = 0.8, **grids) -> DataFrame:
    """stages() over models fitted on the first fraction of dates, one for each entry of occurrence and size (options of learned.occurrence_trees() and
    size_trees()). All fits run over one written table of features, the later dates are scored once."""
    rows = materialize(fraction_split(L.training_rows(panel), fraction), "rows")
    train, valid = rows.where("NOT is_valid"), rows.where("is_valid").drop("is_valid")
    data = L._vector(train).withColumn("label", (F.col("y") > 0).cast("double"))
    sold = data.where("label = 1").withColumn("target", F.log1p("y"))
    pos, n = data.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    occurs: list[Callable] = [lambda x, p=pos / n if n else 0.0: np.full(len(x), p)] if pos in (0, n) else []
    sizes: list[Callable] = [] if pos else [lambda x: np.zeros(len(x))]
    makers = [*[lambda o=o: L.occurrence_trees(data, **o) for o in occurrence if not occurs], *[lambda o=o: L.size_trees(sold, **o)[0] for o in size if not sizes]]
    fitted = concurrently(makers)
    k = 0 if occurs else len(occurrence)
    occurs = occurs or [lambda x, t=t: 1 / (1 + np.exp(-2 * t(x))) for t in fitted[:k]]
    sizes = sizes or [lambda x, t=t: np.maximum(np.expm1(np.minimum(t(x), 30.0)), 0) for t in fitted[k:]]
    return stages(materialize(score_stages(valid, occurs, sizes), "scored"), train, **grids)


# tuning by several measures of one recursive run


def objectives(rows: DataFrame, early: int = EARLY, eps: float = 1.0) -> DataFrame:
    """Of rows candidate, date, y and pred, by candidate: bounded error and weighted error of all days and of the first `early` distinct dates, shortfall on early
    sale days, false sales and flatness in per cent, rates of forecast and actual sale days."""
    finite = M.scored(rows)
    edge = F.broadcast(finite.select("date").distinct().orderBy("date").limit(early).agg(F.max("date").alias("__edge")))  # one row
    y, pred = F.col("y"), F.col("pred")
    soon = F.col("date") <= F.col("__edge")
    soon_y, soon_pred = F.when(soon, y), F.when(soon, pred)
    told = finite.crossJoin(edge).groupBy("candidate").agg(
        F.avg(F.least(M.ape(y, pred, eps), F.lit(100.0))).alias("mape"),
        M.wmape(y, pred, eps).alias("wmape"),
        F.avg(F.when(soon, F.least(M.ape(y, pred, eps), F.lit(100.0)))).alias("early_mape"),
        M.wmape(soon_y, soon_pred, eps).alias("early_wmape"),
        _zero(M.under_forecast(soon_y, soon_pred, eps)).alias("early_under"),
        (100.0 * _zero(M.false_positive_rate(y, pred))).alias("fpr_pct"),
        _zero(F.avg(F.when(y > 0, M.ape(y, pred, eps)))).alias("positive_mape"),
        F.avg((pred > 0).cast("double")).alias("pred_rate"),
        F.avg((y > 0).cast("double")).alias("actual_rate"),
    )
    return told.join(F.broadcast(M.flatness(finite, eps=eps, by=("candidate",))), "candidate")  # a row per candidate


def _goal(goal: str) -> str:
    if goal not in ("wmape", "mape"):
        raise ValueError("goal must be wmape or mape")
    return goal


def count_score(goal: str = "wmape", fitted: str = "fitted") -> Column:
    """0.60 of the error, 0.25 of the early one and 0.15 of early shortfall; more where the fit failed."""
    return 0.60 * F.col(_goal(goal)) + 0.25 * F.col(f"early_{goal}") + 0.15 * F.col("early_under") + F.when(F.col(fitted), 0.0).otherwise(FAILED)


def two_stage_score(goal: str = "wmape") -> Column:
    """The error, false sales (0.20 of them, 0.35 beside the bounded error) and 0.30 of the flatness."""
    return F.col(_goal(goal)) + (0.20 if goal == "wmape" else 0.35) * F.col("fpr_pct") + 0.30 * F.col("flatness")


def global_score() -> Column:
    """0.7 weighted error, 0.2 error on sale days, 0.1 rate of false sales."""
    return 0.7 * F.col("wmape") + 0.2 * F.col("positive_mape") + 0.1 * F.col("fpr_pct") / 100.0


def _trail(core: DataFrame, held: DataFrame, candidates: list[tuple[dict, Callable]], score: Column, order: list[str], raw_state: bool = False) -> DataFrame:
    """Settings, objectives, score and is_best of every candidate: all forecast in one recursive job."""
    preds = L.recursive_each(core, held, [model for _, model in candidates], raw_state)
    told = objectives(materialize(preds, "candidates").select("date", "y", F.posexplode("preds").alias("candidate", "pred")))
    settings = core.sparkSession.createDataFrame([{"candidate": k, **c} for k, (c, _) in enumerate(candidates)])
    out = told.join(F.broadcast(settings), "candidate").withColumn("score", score)
    return out.withColumn("is_best", F.row_number().over(Window.orderBy(F.round("score", PLACES), *order, "candidate")) == 1)  # a row per candidate


def _held(panel: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    parts = materialize(last_days_split(panel.select("sku", "date", "y"), days), "parts")
    return parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")


def tune_counts(panel: DataFrame, days: int = 42, taus: tuple[float, ...] = (0.40, 0.50), clips: tuple[float, ...] = (0.98, 0.99), goal: str = "wmape", steps: int = 40) -> DataFrame:
    """The count model's gate, clipping quantile and cap, chosen on the last days. Settings that clip training counts at the same value share a fit; a fit that can't
    take a step counts as failed."""
    core, held = _held(panel, days)
    rows = materialize(L.training_rows(core), "rows")
    caps = sorted(set(post.candidate_caps(rows).first()))
    clip = {q: rows.agg(F.ceil(F.percentile(F.when(F.col("y") > 0, F.col("y")), q))).first()[0] for q in clips}
    limit = {(q, c): min(float(clip[q]) if clip[q] is not None else c, c) for q in clips for c in caps}
    own = sorted(set(limit.values()))
    fits = dict(zip(own, concurrently([lambda v=v: L.fit_counts(rows, steps=steps, cap=v) for v in own]), strict=True))
    candidates = [({"tau": t, "clip_q": q, "cap": c, "fitted": len(fits[limit[q, c]].trail) > 1}, replace(fits[limit[q, c]], tau=t, cap=c)) for t in taus for q in clips for c in caps]
    return _trail(core, held, candidates, count_score(goal), [f"early_{goal}", goal])


def tune_two_stage(panel: DataFrame, days: int = 42, fits: tuple[dict, ...] = ({"trees": 15, "depth": 4},), taus: tuple[float, ...] = (0.15, 0.20), anchors: tuple[float, ...] = (0.35, 0.40), floors: tuple[float, ...] = (0.0,), goal: str = "wmape") -> DataFrame:
    """Fit options, gate, weekly anchor and floor of the occurrence and size trees, chosen on the last days; decisions share their fit."""
    core, held = _held(panel, days)
    rows = materialize(L.training_rows(core), "rows")
    # one at a time: fits of one table share what they keep in memory
    models = concurrently([lambda o=o: L.fit_two_stage(rows, **o) for o in fits], 1)
    decisions = combinations({"tau": list(taus), "anchor": list(anchors), "floor": list(floors)})
    return _trail(core, held, [({"fit": k, **d}, replace(m, **d)) for k, m in enumerate(models) for d in decisions], two_stage_score(goal), [goal])


#: What search_global() draws from.
GLOBAL = {"loss": list(L.LOSSES), "trees": [10, 20], "depth": [3, 5], "cap_q": [0.98, 0.995], "recent": [1.5, 2.0]}


def search_global(panel: DataFrame, draws: int | None = 8, space: dict[str, list] = GLOBAL, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Loss, trees, cap and recency weight of the global model, drawn without repetition, fitted on the first fraction of dates and scored on the rest."""
    parts = materialize(fraction_split(panel.select("sku", "date", "y"), fraction), "parts")
    core, held = parts.where("NOT is_valid").drop("is_valid"), parts.where("is_valid").drop("is_valid")
    drawn = combinations(space, draws, seed)
    rows = {r: materialize(L.weight(L.training_rows(core), r), "rows") for r in {d["recent"] for d in drawn}}
    cap = {r.cap_q: r.cap for r in caps_by_quantile(core, tuple({d["cap_q"] for d in drawn})).collect()}
    models = concurrently([lambda d=d: L.fit_global(rows[d["recent"]], d["trees"], d["depth"], "weight", seed, d["loss"], cap=cap[d["cap_q"]]) for d in drawn])
    return _trail(core, held, list(zip(drawn, models, strict=True)), global_score(), ["wmape"], raw_state=True)
