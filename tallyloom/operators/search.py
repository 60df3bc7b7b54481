"""Parameter search: a grid of candidates is a small table, so one job scores all candidates on all series."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import metrics as M
from tallyloom.operators.panel import series


def combinations(space: dict[str, list], draws: int | None = None, seed: int = 42) -> list[dict]:
    """All combinations of a space, or so many of them without repetition."""
    every = list(itertools.product(*space.values()))
    chosen = every if draws is None or draws >= len(every) else random.Random(seed).sample(every, draws)
    return [dict(zip(space, c, strict=True)) for c in chosen]


def grid(spark: SparkSession, space: dict[str, list[float]], draws: int | None = None, seed: int = 42) -> DataFrame:
    """The same as a small table: a row each."""
    return spark.createDataFrame([(k, *map(float, c.values())) for k, c in enumerate(combinations(space, draws, seed))], ["candidate", *space])


def search_tsb(train: DataFrame, valid: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate, its parameters and score on valid, best first: bounded error + 50 false-sale rate + 0.2 overshoot. The candidates
    are broadcast (a handful of rows); each series folds once per candidate."""
    v = F.col("values")
    pos = F.filter(v, lambda x: x > 0)
    folded = series(train).crossJoin(F.broadcast(candidates))
    start_p, start_d = (F.get(v, F.lit(0)) > 0).cast("double"), F.coalesce(F.get(pos, F.lit(0)), F.lit(0.0))
    step = F.reduce(
        v,
        F.struct(start_p.alias("p"), start_d.alias("d")),
        lambda acc, x: F.struct(
            (F.col("alpha_p") * (x > 0).cast("double") + (1 - F.col("alpha_p")) * acc["p"]).alias("p"),
            F.when(x > 0, F.col("alpha_d") * x + (1 - F.col("alpha_d")) * acc["d"]).otherwise(acc["d"]).alias("d"),
        ),
        lambda acc: F.greatest(acc["p"] * acc["d"], F.lit(0.0)),
    )
    flat = folded.select("sku", "candidate", "alpha_p", "alpha_d", step.alias("pred"))
    rows = valid.join(flat, "sku")
    y, pred = F.col("y"), F.col("pred")
    scores = rows.groupBy("candidate", "alpha_p", "alpha_d").agg(F.avg(F.least(M.ape(y, pred), F.lit(100.0))).alias("error"), F.coalesce(M.false_positive_rate(y, pred), F.lit(0.0)).alias("fpr"), M.overshoot(y, pred).alias("over"))
    return scores.withColumn("score", F.col("error") + 50 * F.col("fpr") + 0.2 * F.col("over")).orderBy("score", "candidate")


def search_gate(scored: DataFrame, taus: list[float], alphas: list[float]) -> DataFrame:
    """tau, alpha and score of every gate over one scored validation table: the model is scored once, decisions are a broadcast grid."""
    decisions = F.broadcast(grid(scored.sparkSession, {"tau": taus, "alpha": alphas}))
    y = F.col("y")
    pred = F.when(F.col("p_sale") < F.col("tau"), 0.0).otherwise(F.col("alpha") * F.col("pred"))
    rows = scored.crossJoin(decisions).withColumn("gated", pred)
    g = F.col("gated")
    return rows.groupBy("tau", "alpha").agg((0.7 * M.wmape(y, g) + 0.2 * 100 * F.coalesce(M.false_positive_rate(y, g), F.lit(0.0)) + 0.1 * M.under_forecast(y, g)).alias("score")).orderBy("score", "tau", "alpha")


