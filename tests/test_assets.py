"""Forecast assets: futures of every model, their round trip through files, and observed histories."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import serving as V
from tallyloom.plans import catalog
from tallyloom.sources.tables import FORECAST_SCHEMA, write_table

DAY = datetime.date(2024, 1, 1)


def frame(spark, names=("Mug, large", 'Tray "A"')):
    rows = [(n, DAY + datetime.timedelta(d), 0.1 + d / 3, 0.5, "extra") for n in names for d in range(3)]
    return spark.createDataFrame(rows, "product_family_name string, date date, pred_two_stage double, p_sale double, note string")


@pytest.mark.parametrize("suffix", [".csv", ".parquet", ".jsonl"])
def test_assets_are_read_as_written(spark, tmp_path, suffix):
    made = V.canonical(frame(spark), 3, "2026-01-01T00:00:00Z")
    back = V.write_asset(made, str(tmp_path / f"a{suffix}"))
    assert back.columns == FORECAST_SCHEMA.names
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.select(*FORECAST_SCHEMA.names).collect()))
    with pytest.raises(ValueError, match="no rows"):
        V.write_asset(made.limit(0), str(tmp_path / f"b{suffix}"))


def test_a_text_that_the_format_breaks_is_an_error(spark, tmp_path):
    made = V.canonical(frame(spark, ("two\nlines",)), 3, "x")
    with pytest.raises(ValueError, match="written"):
        V.write_asset(made, str(tmp_path / "a.csv"))


def test_observed_history(spark, tmp_path):
    path = str(tmp_path / "panel.parquet")
    assert V.observed_history(spark, path).count() == 0 and V.observed_history(spark, path).columns == ["sku", "date", "y"]
    write_table(spark.createDataFrame([(s, DAY + datetime.timedelta(d), d, "x") for s, n in (("a", 5), ("b", 2)) for d in range(n)] + [(None, None, None, None)], "sku string, date date, y int, extra string"), path)
    assert V.observed_history(spark, path).count() == 8
    assert [tuple(r) for r in V.observed_history(spark, path, " a ", 2).orderBy("date").collect()] == [("a", DAY + datetime.timedelta(d), float(d)) for d in (3, 4)]
    assert V.observed_history(spark, path, " ", 1).groupBy("sku").count().count() == 2 and V.observed_history(spark, path, "c", 1).count() == 0


def test_futures_of_every_model(spark, small):
    got = catalog.QUERIES["future_assets"](spark, small)
    told = {r.cluster: r for r in got.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("product_key").alias("products"), F.countDistinct("forecast_date").alias("days"), F.min("forecast_value").alias("least")).collect()}
    assert set(told) == set(V.MODELS)
    assert all(r.days == V.LONGEST_HORIZON and r.n == r.products * r.days and r.least >= -1e-9 for r in told.values())
