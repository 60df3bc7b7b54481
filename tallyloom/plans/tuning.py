"""The scoring of given forecasts by the searches' objectives, which SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import tuning as T
from tallyloom.operators import univariate as U
from tallyloom.operators.panel import fraction_split
from tallyloom.plans.panels import rounded, split
from tallyloom.plans.registry import query


@query(
    """WITH edge AS (SELECT max(date) AS edge FROM (SELECT DISTINCT date FROM naive ORDER BY date LIMIT 14)),
    settings AS (SELECT CAST(k AS INTEGER) AS candidate, ([0, 30000])[k // 2 + 1]::DOUBLE AS t, ([0.8, 1.0])[k % 2 + 1]::DOUBLE AS a FROM range(4) AS r(k)),
    rows AS (SELECT candidate, date, y, CASE WHEN pred < t THEN 0 ELSE a * pred END AS pred, date <= edge AS soon FROM naive, settings, edge),
    errors AS (SELECT *, abs(y - pred) AS e, abs(y - pred) / greatest(abs(y), 1) * 100 AS ape FROM rows),
    told AS (SELECT candidate, avg(least(ape, 100)) AS mape, sum(e) / greatest(sum(abs(y)), 1) * 100 AS wmape, avg(least(ape, 100)) FILTER (WHERE soon) AS early_mape,
        sum(e) FILTER (WHERE soon) / greatest(sum(abs(y)) FILTER (WHERE soon), 1) * 100 AS early_wmape,
        coalesce(avg(greatest(y - pred, 0) / greatest(abs(y), 1) * 100) FILTER (WHERE soon AND y > 0), 0) AS early_under,
        100 * coalesce(count(*) FILTER (WHERE y <= 0 AND pred > 0) / nullif(count(*) FILTER (WHERE y <= 0), 0), 0) AS fpr_pct,
        coalesce(avg(ape) FILTER (WHERE y > 0), 0) AS positive_mape, count(*) FILTER (WHERE pred > 0) / count(*) AS pred_rate, count(*) FILTER (WHERE y > 0) / count(*) AS actual_rate FROM errors GROUP BY 1),
    totals AS (SELECT candidate, date, sum(y) AS a, sum(pred) AS p FROM rows GROUP BY 1, 2),
    moved AS (SELECT *, a - lag(a) OVER (PARTITION BY candidate ORDER BY date) AS da, p - lag(p) OVER (PARTITION BY candidate ORDER BY date) AS dp FROM totals),
    flat AS (SELECT candidate, 100 * (greatest(0, 0.45::DOUBLE - stddev_pop(p) / greatest(stddev_pop(a), 1)) + 1.25::DOUBLE * coalesce(greatest(0, 0.5::DOUBLE - stddev_pop(dp) / greatest(stddev_pop(da), 1)), 0)) AS flatness FROM moved GROUP BY 1),
    scored AS (SELECT *, 0.6::DOUBLE * wmape + 0.25::DOUBLE * early_wmape + 0.15::DOUBLE * early_under + CASE WHEN candidate < 3 THEN 0 ELSE 25 END AS count_score,
        wmape + 0.2::DOUBLE * fpr_pct + 0.3::DOUBLE * flatness AS two_stage_score, 0.7::DOUBLE * wmape + 0.2::DOUBLE * positive_mape + 0.1::DOUBLE * fpr_pct / 100 AS global_score FROM told JOIN flat USING (candidate))
    SELECT candidate, round(mape, 4) AS mape, round(wmape, 4) AS wmape, round(early_mape, 4) AS early_mape, round(early_wmape, 4) AS early_wmape, round(early_under, 4) AS early_under, round(fpr_pct, 4) AS fpr_pct,
        round(positive_mape, 4) AS positive_mape, round(pred_rate, 4) AS pred_rate, round(actual_rate, 4) AS actual_rate, round(flatness, 4) AS flatness, candidate < 3 AS fitted,
        round(count_score, 4) AS count_score, round(two_stage_score, 4) AS two_stage_score, round(global_score, 4) AS global_score FROM scored""",
    "naive",
)
def tuning_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives and scores of four gates and scales of the weekly pattern, of which the last counts as a failed fit."""
    pred = F.col("pred")
    gated = [F.when(pred < t, 0.0).otherwise(a * pred) for t in (0.0, 30000.0) for a in (0.8, 1.0)]
    rows = U.naive7(*split(spark, sf_dir)).select("date", "y", F.posexplode(F.array(*gated)).alias("candidate", "pred"))
    told = T.objectives(rows).withColumn("fitted", F.col("candidate") < 3)
    return rounded(told.withColumns({"count_score": T.count_score(), "two_stage_score": T.two_stage_score(), "global_score": T.global_score()}), 4)


@query(
    """WITH days AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM train)),
    edge AS (SELECT date AS c FROM days WHERE r = greatest(1, least(floor(n * 0.8), n - 1))),
    core AS (SELECT train.* FROM train, edge WHERE date <= c),
    whole AS (SELECT sku, round(avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS p0, round(avg(y) FILTER (WHERE y > 0), 4) AS s0, round(quantile_cont(y, 0.5) FILTER (WHERE y > 0), 4) AS s1 FROM core GROUP BY 1),
    daily_share AS (SELECT sku, isodow(date) AS wd, round(avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS p1 FROM core GROUP BY 1, 2),
    rows AS (SELECT y, coalesce(p0, 0) AS p0, coalesce(p1, 0) AS p1, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1 FROM train JOIN edge ON date > c LEFT JOIN whole USING (sku) LEFT JOIN daily_share d ON d.sku = train.sku AND d.wd = isodow(train.date)),
    taus AS (SELECT unnest([0.3, 0.4, 0.45, 0.55]::DOUBLE[]) AS tau), alphas AS (SELECT unnest([0.95, 1.0, 1.1, 1.2]::DOUBLE[]) AS alpha),
    caps AS (SELECT q AS cap_q, quantile_cont(y, 0.95) FILTER (WHERE y > 0) AS cap FROM core, (SELECT 0.95::DOUBLE AS q) GROUP BY 1 UNION ALL SELECT q, quantile_cont(y, 0.98) FILTER (WHERE y > 0) FROM core, (SELECT 0.98::DOUBLE AS q) GROUP BY 1
        UNION ALL SELECT q, quantile_cont(y, 0.995) FILTER (WHERE y > 0) FROM core, (SELECT 0.995::DOUBLE AS q) GROUP BY 1),
    sells AS (SELECT CAST(0 AS INTEGER) AS occurrence, tau, y, p0 >= tau AS s FROM rows, taus UNION ALL SELECT CAST(1 AS INTEGER), tau, y, p1 >= tau FROM rows, taus),
    counted AS (SELECT occurrence, tau, coalesce(count(*) FILTER (WHERE s AND y > 0) / nullif(count(*) FILTER (WHERE y > 0), 0), 0) AS recall, coalesce(count(*) FILTER (WHERE s AND y <= 0) / nullif(count(*) FILTER (WHERE y <= 0), 0), 0) AS fpr,
        count(*) FILTER (WHERE s) / count(*) AS pred_rate, count(*) FILTER (WHERE y > 0) / count(*) AS actual_rate FROM sells GROUP BY 1, 2),
    first AS (SELECT *, abs(pred_rate - actual_rate) + 0.8::DOUBLE * fpr + 0.4::DOUBLE * (1 - recall) AS score FROM counted),
    gate AS (SELECT occurrence, tau FROM first ORDER BY round(score, 6), occurrence, tau LIMIT 1),
    sized AS (SELECT k AS size_model, alpha, cap_q, y, CASE WHEN p < tau THEN 0 ELSE least(greatest(alpha * (p * size), 0), cap) END AS pred FROM (SELECT y, tau, CASE WHEN occurrence = 0 THEN p0 ELSE p1 END AS p, unnest([0, 1]::INTEGER[]) AS k, unnest([s0, s1]) AS size FROM rows, gate), alphas, caps),
    usual AS (SELECT greatest(coalesce(quantile_cont(y, 0.5) FILTER (WHERE y > 0), 0), 1) AS usual FROM rows),
    told AS (SELECT size_model, alpha, cap_q, sum(abs(y - pred)) / greatest(sum(abs(y)), 1) * 100 AS wmape, coalesce(avg(abs(y - pred) / greatest(abs(y), 1) * 100) FILTER (WHERE y > 0), 0) AS positive_mape,
        coalesce(count(*) FILTER (WHERE pred > 0 AND y <= 0) / nullif(count(*) FILTER (WHERE y <= 0), 0), 0) AS fpr, coalesce(avg(pred) FILTER (WHERE y <= 0 AND pred > 0), 0) / any_value(usual) * 100 AS over,
        coalesce(count(*) FILTER (WHERE pred > 0 AND y > 0) / nullif(count(*) FILTER (WHERE y > 0), 0), 0) AS recall, count(*) FILTER (WHERE pred > 0) / count(*) AS pred_rate, count(*) FILTER (WHERE y > 0) / count(*) AS actual_rate FROM sized, usual GROUP BY 1, 2, 3),
    second AS (SELECT *, 0.6::DOUBLE * wmape + 0.4::DOUBLE * positive_mape + lambda_fp * fpr + 0.1::DOUBLE * lambda_over * over + 100 * lambda_recall * (1 - recall) + 3000 * abs(pred_rate - actual_rate) AS score
        FROM told, gate, (SELECT unnest([1, 5, 10]::DOUBLE[]) AS lambda_fp), (SELECT unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS lambda_over), (SELECT unnest([5, 10]::DOUBLE[]) AS lambda_recall)),
    trail AS (SELECT 'occurrence' AS stage, occurrence, tau, -1 AS size_model, NULL::DOUBLE AS alpha, NULL::DOUBLE AS cap_q, NULL::DOUBLE AS lambda_fp, NULL::DOUBLE AS lambda_over, NULL::DOUBLE AS lambda_recall, recall, fpr, pred_rate, actual_rate, NULL::DOUBLE AS wmape, NULL::DOUBLE AS positive_mape, NULL::DOUBLE AS over, score FROM first
        UNION ALL SELECT 'size', occurrence, tau, size_model, alpha, cap_q, lambda_fp, lambda_over, lambda_recall, recall, fpr, pred_rate, actual_rate, wmape, positive_mape, over, score FROM second)
    SELECT stage, occurrence, tau, size_model, alpha, cap_q, lambda_fp, lambda_over, lambda_recall, round(recall, 4) AS recall, round(fpr, 4) AS fpr, round(pred_rate, 4) AS pred_rate, round(actual_rate, 4) AS actual_rate, round(wmape, 4) AS wmape,
        round(positive_mape, 4) AS positive_mape, round(over, 4) AS over, round(score, 4) AS score, row_number() OVER (PARTITION BY stage ORDER BY round(score, 6), occurrence, tau, size_model, alpha, cap_q, lambda_fp, lambda_over, lambda_recall) = 1 AS is_best FROM trail""",
    "train",
)
def staged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages of the search over models that SQL can say: shares of sale days, whole and by weekday, and mean and median sizes."""
    parts = fraction_split(split(spark, sf_dir)[0])
    core, valid = parts.where("NOT is_valid"), parts.where("is_valid")
    sells, size = F.avg((F.col("y") > 0).cast("double")), F.when(F.col("y") > 0, F.col("y"))
    whole = core.groupBy("sku").agg(F.round(sells, 6).alias("p0"), F.round(F.avg(size), 4).alias("s0"), F.round(F.percentile(size, 0.5), 4).alias("s1"))
    by_day = core.groupBy("sku", F.weekday("date").alias("wd")).agg(F.round(sells, 6).alias("p1"))
    rows = valid.withColumn("wd", F.weekday("date")).join(whole, "sku", "left").join(by_day, ["sku", "wd"], "left")
    known = lambda *c: F.array(*[F.coalesce(x, F.lit(0.0)) for x in c])
    trail = T.stages(rows.select("sku", "date", "y", known("p0", "p1").alias("ps"), known("s0", "s1").alias("sizes")), core)
    exact = ("tau", "alpha", "cap_q", "lambda_fp", "lambda_over", "lambda_recall")
    return rounded(trail.drop("cap"), 4).select("stage", "occurrence", F.coalesce("size_model", F.lit(-1)).alias("size_model"), *exact, "recall", "fpr", "pred_rate", "actual_rate", "wmape", "positive_mape", "over", "score", "is_best")
