"""Learned models, clusters and searches. Their results depend on the fitted models, so there is no SQL for them; tests check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import learned as L
from tallyloom.operators import search as R
from tallyloom.operators import segment as G
from tallyloom.operators import stats as S
from tallyloom.operators import univariate as U
from tallyloom.operators.panel import fraction_split
from tallyloom.plans.panels import daily, dense, rounded, split
from tallyloom.plans.registry import query
from tallyloom.session import materialize
from tallyloom.sources.retail import table


@query()
def kmeans_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series in five clusters by their statistics, with mean and median profiles."""
    panel = dense(spark, sf_dir)
    rows = S.level(panel).join(S.intermittency(panel).select("sku", "adi", F.coalesce("cv2", F.lit(0.0)).alias("cv2")), "sku")
    columns = ["total_sales", "cv", "nonzero_rate", "avg_gap", "adi", "cv2"]
    labelled, _ = G.kmeans(G.standardized(rows, columns), columns, 5, starts=3)
    return rounded(G.shifted_profiles(rows.join(labelled.select("sku", "cluster_kmeans"), "sku"), "cluster_kmeans", columns))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings with a column per dimension, and those columns' names."""
    rows = table(spark, sf_dir, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    columns = [f"e{k}" for k in range(width)]
    return rows.select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(columns)]), columns


@query()
def gmm_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIC of Gaussian mixtures over all dimensions of the embeddings, by number of parts."""
    rows, columns = vectors(spark, sf_dir)
    rows = rows.persist()
    found = [(k, float(G.gaussian_mixture(rows, columns, k)[1])) for k in (2, 3, 4)]
    rows.unpersist()
    return spark.createDataFrame(found, "k int, bic double")


@query()
def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia and silhouette of k-means over the embeddings, for 2 to 18 clusters."""
    rows, columns = vectors(spark, sf_dir)
    return G.sweep(rows, columns, range(2, 19))


@query()
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted Rand index between k-means labellings of the embeddings from different seeds."""
    rows, columns = vectors(spark, sf_dir)
    labels = [G.kmeans(rows, columns, 4, starts=1, seed=s)[0].select("vec_id", F.col("cluster_kmeans").alias(f"s{s}")) for s in (1, 2, 3)]
    both = labels[0].join(labels[1], "vec_id").join(labels[2], "vec_id")
    out = None
    for a, b in ((1, 2), (1, 3), (2, 3)):
        one = G.rand_index(both, f"s{a}", f"s{b}").select(F.lit(a).alias("seed_i"), F.lit(b).alias("seed_j"), F.round("ari", 6).alias("ari"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def two_stage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive forecasts of the last days by occurrence and size trees."""
    train, test = split(spark, sf_dir)
    model = L.fit_two_stage(L.training_rows(train), tau=0.2, anchor=0.4)
    return L.recursive(train, test, model)


@query()
def global_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive forecasts by one weighted regression over all series. Lines are joined and summed once, and the rows of the fit are a table, as the fit reads
    them several times."""
    train, test = split(spark, sf_dir, materialize(daily(spark, sf_dir), "daily"))
    model = L.fit_global(materialize(L.weight(L.training_rows(train)), "rows"), weight="weight")
    return L.recursive(train, test, model, raw_state=True)


@query()
def zero_inflated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive forecasts of demand in hundreds by the zero-inflated count model."""
    train, test = split(spark, sf_dir)
    hundreds = lambda df: df.withColumn("y", F.greatest(F.col("y") / 100, F.lit(0.0)))
    model = L.fit_counts(L.training_rows(hundreds(train)), cap=2000.0)
    return L.recursive(hundreds(train), hundreds(test), model)


_FOLD = """list_reduce(list_prepend({'p': CASE WHEN v[1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 'd': coalesce(pos[1], 0.0::DOUBLE), 'y': 0.0::DOUBLE}, list_transform(v, lambda x: {'p': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'y': x})),
    lambda a, x: {'p': alpha_p * (CASE WHEN x.y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + (1 - alpha_p) * a.p, 'd': CASE WHEN x.y > 0 THEN alpha_d * x.y + (1 - alpha_d) * a.d ELSE a.d END, 'y': 0.0::DOUBLE})"""


@query(
    f"""WITH days AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM train)),
    edge AS (SELECT date AS c FROM days WHERE r = greatest(1, least(floor(n * 0.8), n - 1))),
    settings AS (SELECT CAST(k AS BIGINT) AS candidate, ([0.05, 0.1, 0.2])[k // 3 + 1]::DOUBLE AS alpha_p, ([0.1, 0.2, 0.4])[k % 3 + 1]::DOUBLE AS alpha_d FROM range(9) AS t(k)),
    s AS (SELECT sku, list(y ORDER BY date) AS v, list(y ORDER BY date) FILTER (WHERE y > 0) AS pos FROM train, edge WHERE date <= c GROUP BY 1),
    folded AS (SELECT sku, candidate, alpha_p, alpha_d, {_FOLD} AS f FROM s CROSS JOIN settings),
    rows AS (SELECT candidate, alpha_p, alpha_d, y, greatest(f.p * f.d, 0) AS pred FROM train JOIN edge ON date > c JOIN folded USING (sku)),
    parts AS (SELECT candidate, alpha_p, alpha_d, avg(least(abs(y - pred) / greatest(abs(y), 1) * 100, 100)) AS error, coalesce(count(*) FILTER (WHERE y <= 0 AND pred > 0) / nullif(count(*) FILTER (WHERE y <= 0), 0), 0) AS fpr,
        coalesce(avg(pred) FILTER (WHERE y <= 0 AND pred > 0) / greatest(coalesce(quantile_cont(y, 0.5) FILTER (WHERE y > 0), 0), 1) * 100, 0) AS over FROM rows GROUP BY ALL)
    SELECT candidate, alpha_p, alpha_d, round(error, 4) AS error, round(fpr, 4) AS fpr, round(over, 4) AS over, round(error + 50 * fpr + 0.2 * over, 4) AS score FROM parts""",
    "train",
)
def tsb_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all smoothing settings on the last fifth of the training days."""
    parts = fraction_split(split(spark, sf_dir)[0])
    candidates = R.grid(spark, {"alpha_p": [0.05, 0.1, 0.2], "alpha_d": [0.1, 0.2, 0.4]})
    return rounded(R.search_tsb(parts.where("NOT is_valid").drop("is_valid"), parts.where("is_valid").drop("is_valid"), candidates), 4)


@query()
def gate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all gates over one scored validation table."""
    rows = fraction_split(L.training_rows(split(spark, sf_dir)[0]))
    model = L.fit_two_stage(rows.where("NOT is_valid"), trees=8, tau=0.0)
    return R.search_gate(L.score(rows.where("is_valid").drop("is_valid"), model), [0.1, 0.25, 0.4], [0.8, 0.9, 1.0])


@query()
def registered_forecaster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own function as a forecaster: the median of the last 28 days."""
    train = split(spark, sf_dir)[0]
    return U.apply_forecaster(train, lambda values, horizon: [float(sorted(values[-28:])[len(values[-28:]) // 2])] * horizon, 14)
