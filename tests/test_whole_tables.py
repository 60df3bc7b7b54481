"""Queries that must take whole tables, against pandas or counts."""

import numpy as np
from pyspark.sql import functions as F

from tallyloom.plans import catalog, panels
from tallyloom.sources.retail import table


def test_exponential_history_of_all_days(spark, small):
    panel = panels.dense(spark, small)
    got = catalog.QUERIES["ewm_history"](spark, small)
    assert got.count() == panel.count()
    some = [r.sku for r in panel.select("sku").distinct().orderBy("sku").limit(3).collect()]
    want = panel.where(F.col("sku").isin(some)).toPandas().sort_values(["sku", "date"])
    rows = got.where(F.col("sku").isin(some)).toPandas().sort_values(["sku", "date"])
    means = want.groupby("sku").y.transform(lambda y: y.ewm(span=7, adjust=False).mean().shift(1).fillna(0))
    assert np.allclose(rows.ewm_mean_7, means, atol=1e-5)


def test_count_targets_are_clipped_not_dropped(spark, small):
    train = panels.split(spark, small)[0].toPandas()
    got = catalog.QUERIES["count_targets"](spark, small).toPandas()
    want = np.minimum(np.round(np.maximum(train.y / 100, 0)), 200)
    assert len(got) == len(train) and (train.y > 20_000).any()
    assert sorted(got.n) == sorted(want)


def test_lists_hold_all_parts_and_products(spark, small):
    q = {n: catalog.QUERIES[n](spark, small) for n in ("resolve_cascade", "unavailable_match", "forecast_lookup", "zero_panel_union", "canonical_forecast")}
    parts = table(spark, small, "part")
    status = {r.query: r.status for r in q["resolve_cascade"].collect()}
    asked = parts.select("p_partkey", "p_name").collect()
    assert {status[f" {r.p_partkey}. "] for r in asked} == {"resolved"} and {status[f"{r.p_name} discontinued"] for r in asked} == {"not_found"}
    assert q["unavailable_match"].count() == parts.select("p_name").distinct().count()
    assert q["forecast_lookup"].count() == q["canonical_forecast"].select("product_key").distinct().count() * 14
    sums = [df.agg(F.count("*"), F.round(F.sum("y"), 2)).first() for df in (q["zero_panel_union"], panels.dense(spark, small))]
    assert sums[0] == sums[1]
