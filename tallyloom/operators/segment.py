"""Demand segments, clusters and their comparison."""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADI_CUT, CV2_CUT, SEASONAL_CUT, SPIKE_CUT = 1.32, 0.49, 0.30, 5.0


def segment3(adi: Column, cv2: Column) -> Column:
    """regular, intermittent or lumpy; undefined variation counts as lumpy."""
    return F.when(adi <= ADI_CUT, "regular").when(F.coalesce(cv2 <= CV2_CUT, F.lit(False)), "intermittent").otherwise("lumpy")


def flags(adi: Column, cv2: Column, spike: Column) -> dict[str, Column]:
    return {"erratic_flag": F.coalesce(cv2 > CV2_CUT, F.lit(False)) & (adi <= ADI_CUT), "spike_flag": F.coalesce(spike >= SPIKE_CUT, F.lit(False))}


def summary(segments: DataFrame) -> DataFrame:
    """Size, medians and rates of each segment."""
    return segments.groupBy("segment").agg(F.count("*").alias("n"), F.median("adi").alias("adi_median"), F.median("cv2").alias("cv2_median"), F.avg(F.col("erratic_flag").cast("double")).alias("erratic_rate"), F.avg(F.col("spike_flag").cast("double")).alias("spike_rate"))


def shifted_profiles(rows: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """cluster, feature, mean, median, shift (mean - median) and relative shift (null where the median is 0), in one pass."""
    wide = rows.groupBy(cluster).agg(*[f for c in columns for f in (F.avg(c).alias(f"{c}__mean"), F.median(c).alias(f"{c}__median"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__median").alias("median")) for c in columns]))
    shift = F.col("r.mean") - F.col("r.median")
    return wide.select(cluster, each.alias("r")).select(cluster, "r.feature", "r.mean", "r.median", shift.alias("shift"), F.try_divide(shift, F.nullif(F.col("r.median"), F.lit(0.0))).alias("relative_shift"))


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns centred and scaled by their population deviation (1 where that is 0)."""
    one = rows.agg(*[f for c in columns for f in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return rows.crossJoin(F.broadcast(one)).withColumns(scaled).select(*rows.columns)


def nonzero_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns with a value other than 0, by one pass."""
    found = rows.agg(*[F.max(F.abs(F.coalesce(c, F.lit(0.0)))).alias(c) for c in columns]).first()
    return [c for c in columns if found[c]]


def kmeans(rows: DataFrame, columns: list[str], k: int, starts: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """rows with cluster_kmeans of the start with the least cost, and that cost."""
    data = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(rows).persist()
    try:
        fits = [KMeans(k=k, seed=seed + s, featuresCol="__v", predictionCol="cluster_kmeans").fit(data) for s in range(starts)]
    finally:
        data.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("__v"), best.summary.trainingCost


def sweep(rows: DataFrame, columns: list[str], counts: range, seed: int = 42) -> DataFrame:
    """k, inertia and silhouette (squared distances) of one k-means fit for each number of clusters."""
    data = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(rows).select("__v").persist()
    try:
        out = []
        for k in counts:
            fit = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="__c").fit(data)
            out.append((k, float(fit.summary.trainingCost), float(ClusteringEvaluator(featuresCol="__v", predictionCol="__c").evaluate(fit.transform(data)))))
        return rows.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double")
    finally:
        data.unpersist()


def gaussian_mixture(rows: DataFrame, columns: list[str], k: int, seed: int = 42) -> tuple[DataFrame, float]:
    """rows with cluster_gmm, and the fit's BIC."""
    data = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(rows)
    fit = GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="cluster_gmm", probabilityCol="__p").fit(data)
    d = len(columns)
    free = k * d * (d + 1) / 2 + k * d + k - 1
    n = data.count()
    return fit.transform(data).drop("__v", "__p"), -2 * fit.summary.logLikelihood + free * math.log(max(n, 1))


def rand_index(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from the counts of their contingency table."""
    cells = pairs.groupBy(one, two).agg(F.count("*").alias("n"))
    pick = lambda n: n * (n - 1) / 2
    rows = cells.groupBy(one).agg(F.sum("n").alias("n")).agg(F.sum(pick(F.col("n"))).alias("a"), F.sum("n").alias("total"))
    cols = cells.groupBy(two).agg(F.sum("n").alias("n")).agg(F.sum(pick(F.col("n"))).alias("b"))
    both = cells.agg(F.sum(pick(F.col("n"))).alias("c"))
    joined = rows.crossJoin(cols).crossJoin(both)  # single rows
    expected = F.try_divide(F.col("a") * F.col("b"), pick(F.col("total")))
    top = (F.col("a") + F.col("b")) / 2
    return joined.select(F.coalesce(F.try_divide(F.col("c") - expected, F.nullif(top - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))


def size_rank(labels: DataFrame, column: str) -> DataFrame:
    """Each label's size, share and rank by size."""
    counts = labels.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumns({"share": F.col("n") / F.sum("n").over(Window.partitionBy()), "rank": F.row_number().over(Window.orderBy(F.desc("n"), "label"))})
