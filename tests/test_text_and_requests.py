"""Text functions, request parsing, name resolution, canonical frames, display frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import serving as V
from tallyloom.sources import tables


def one(spark, expression, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expression(*[F.col(n) for n in names]).alias("r")).first().r


def test_normal_forms(spark):
    assert one(spark, X.normalize_desc, "  a \t b ") == "a b" and one(spark, X.normalize_desc, None) == ""
    assert one(spark, X.normalize_text, " Red-hot  lamp's/2 ") == "RED HOT LAMP S 2"
    assert one(spark, X.slugify, "--") == "product" and len(one(spark, X.slugify, "word " * 30)) <= 48
    key = one(spark, lambda n: X.product_key(F.lit(1), n), "CHERRY LIGHTS")
    assert key.startswith("c1-cherry-lights-") and len(key.rpartition("-")[2]) == 8


def test_heuristic_family(spark):
    r = one(spark, X.heuristic_family, "SET OF 3 RED VINTAGE BUTTERFLYSHAPED TINS")
    assert (r.family_name, r.variant_hint) == ("SET 3 BUTTERFLYSHAPED", "RED VINTAGE TINS")
    assert one(spark, X.heuristic_family, "red").family_name == "red"


def test_postprocess_family(spark):
    r = one(spark, X.postprocess_family, "x", "red FELTCRAFT doll", "small")
    assert (r.family_name, r.variant_hint) == ("FELTCRAFT DOLL", "small RED")
    assert one(spark, X.postprocess_family, "PINK 12 X", "pink", "").family_name == "12 X"


@pytest.mark.parametrize(
    ("query", "days", "grain", "product"),
    [
        ("Show me the next 30 days for CHERRY LIGHTS", 30, "daily", "CHERRY LIGHTS"),
        ("Show me the next 8 weeks for stock code 20973", 56, "weekly", "20973"),
        ("Give me a weekly forecast for 12 PENCIL SMALL TUBE WOODLAND for 6 weeks", 42, "weekly", "12 PENCIL SMALL TUBE WOODLAND"),
        ("Give me a forecast for KNICKKNACKTINSSET4", 14, "daily", "KNICKKNACKTINSSET4"),
        ("next 200 days for 'blue mug'", 90, "daily", "blue mug"),
        ("", 14, "daily", ""),
    ],
)
def test_requests(spark, query, days, grain, product):
    r = V.parse_requests(spark.createDataFrame([(query,)], "query string")).first()
    assert (r.horizon_days, r.granularity, r.product_query) == (days, grain, product)


PRODUCT = "product_key string, product_family_name string, normalized_product_name string, product_id string, product_id_norm string, search_aliases_norm array<string>"


@pytest.fixture(scope="module")
def products(spark):
    rows = [("c1-lights", "CHERRY LIGHTS", "CHERRY LIGHTS", "85048", "85048", ["CHERRY LIGHTS", "85048", "CHERRY"]), ("c1-lamp", "CHERRY LAMP", "CHERRY LAMP", "85049", "85049", ["CHERRY LAMP", "CHERRY"])]
    return spark.createDataFrame(rows, PRODUCT)


def ask(spark, *queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def test_exact_and_fuzzy_resolution(spark, products):
    got = {r.query: (r.status, len(r["keys"])) for r in V.resolve(ask(spark, "85048", "cherry", "banana lantern", "Cherry  lights!", "CHERRY LIGHTZ"), products).collect()}
    assert got == {"85048": ("resolved", 1), "cherry": ("ambiguous", 2), "banana lantern": ("not_found", 0), "Cherry  lights!": ("resolved", 1), "CHERRY LIGHTZ": ("ambiguous", 2)}
    assert V.exact_matches(ask(spark, "banana lantern"), products).first().status == "not_found"


def test_unavailable_products(spark, products):
    rows = [("KNICKKNACKTINSSET4", "KNICKKNACKTINSSET4", "", [], "dropped"), ("Adjust bad debt", "ADJUST BAD DEBT", "BADD", [], "excluded"), ("Discount", "DISCOUNT", "DISC", [], "excluded"), ("POSTAGE", "POSTAGE", "85220", [], "cluster_4_excluded")]
    listed = spark.createDataFrame(rows, "product_family_name string, normalized_product_name string, product_id_norm string, search_aliases_norm array<string>, reason_type string")
    asked = ask(spark, "85220", "Give me a forecast for KNICKKNACKTINSSET4", "Give me a weekly forecast for 12 PENCIL SMALL TUBE WOODLAND for 6 weeks")
    assert {(r.query[:5], r.reason_type) for r in V.unavailable(asked, listed).collect()} == {("85220", "cluster_4_excluded"), ("Give ", "dropped")}
    done = {r.query: r.status for r in V.answer(ask(spark, "85220", "85048", "banana"), products, listed).collect()}
    assert done == {"85220": "unavailable", "85048": "resolved", "banana": "not_found"}


def test_canonical_frames(spark):
    pred = spark.createDataFrame([("2011-12-01", "CHERRY LIGHTS", 3, 2.0, 2.5, 0.7), ("2011-12-02", "CHERRY LIGHTS", 3, 0.0, 3.0, 0.8)], "date string, sku_id string, cluster int, y double, pred_two_stage double, p_sale double")
    meta = spark.createDataFrame([("CHERRY LIGHTS", "85048")], "product_family_name string, product_id string")
    out = V.validate_forecast(V.canonical(pred, 3, "2026-01-01T00:00:00Z", meta))
    assert out.columns == [*tables.FORECAST_SCHEMA.names, "actual_value"]
    rows = out.orderBy("forecast_date").collect()
    assert [r.forecast_value for r in rows] == [2.5, 3.0] and {r.product_id for r in rows} == {"85048"} and [r.p_sale for r in rows] == [0.7, 0.8]
    assert "actual_value" not in V.canonical(pred.drop("y"), 3, "x").columns
    with pytest.raises(ValueError):
        V.validate_forecast(spark.createDataFrame([("k",)], "product_key string"))
    with pytest.raises(ValueError):
        V.validate_forecast(out.where("false"))
    with pytest.raises(ValueError):
        V.canonical(pred.drop("pred_two_stage"), 3, "x")


def test_lookup_is_sorted_and_cut(spark):
    rows = [("a", dt.date(2011, 12, d), float(4 + d)) for d in (3, 1, 2)] + [("b", dt.date(2011, 12, 1), 1.0)]
    df = spark.createDataFrame(rows, "product_key string, forecast_date date, forecast_value double")
    got = V.lookup(df, spark.createDataFrame([("a",)], "product_key string"), 2).orderBy("forecast_date").collect()
    assert [r.forecast_value for r in got] == [5.0, 6.0]


def test_weekly_display_and_chart(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0, 2.0, 0.1), ("a", dt.date(2024, 1, 2), 2.0, 1.0, 0.2), ("a", dt.date(2024, 1, 9), 3.0, 4.0, 0.3), ("a", dt.date(2024, 1, 23), 1.0, None, None)]
    df = spark.createDataFrame(rows, "product_key string, forecast_date date, forecast_value double, actual_value double, p_sale double")
    got = [(r.forecast_value, r.actual_value, None if r.p_sale is None else round(r.p_sale, 2)) for r in V.display_weekly(df).orderBy("period_start").collect()]
    assert got == [(3.0, 3.0, 0.15), (3.0, 4.0, 0.3), (0.0, 0.0, None), (1.0, 0.0, None)]
    history = spark.createDataFrame([("a", dt.date(2023, 12, 31), 5.0)], "product_key string, date date, y double")
    assert [(r.segment, r.actual_value) for r in V.chart(history, df).orderBy("date").collect()][:2] == [("history", 5.0), ("forecast", 2.0)]
    assert V.summary(df).first().trend == "stable"


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c', 2.5), ("2", None, None)], "k string, t string, v double")
    for name in ("x.csv", "x.parquet", "x.json"):
        path = tables.write_table(df, f"file://{tmp_path}/{name}")
        assert sorted(map(str, tables.read_table(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))
    rows = spark.createDataFrame([("a", ("F1", "v"), 1), ("a", ("F2", "v"), 2), ("b", ("", None), 1)], tables.CHECKPOINT)
    path = tables.write_table(rows, f"file://{tmp_path}/c.jsonl")
    assert {(r.desc, r.family_name) for r in tables.read_family_map(spark, path).collect()} == {("a", "F2"), ("b", "b")}
    both = tables.read_sheets(spark, {"one": f"file://{tmp_path}/x.parquet", "two": f"file://{tmp_path}/x.parquet"}, ["k"])
    assert both.columns == ["k", "sheet"] and both.count() == 4
    tables.write_manifest(f"{tmp_path}/m/manifest.json", {"rows": 2})
    assert tables.read_manifest(f"{tmp_path}/m/manifest.json") == {"rows": 2} and tables.read_manifest(f"{tmp_path}/none") == {}


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "k int, a double, b double")
    new = spark.createDataFrame([(2, 9.0), (3, 8.0)], "k int, b double")
    got = sorted((r.k, r.a, r.b) for r in tables.upsert_columns(old, new, ["k"]).collect())
    assert got == [(1, 1.0, None), (2, 1.0, 9.0), (3, None, 8.0)]
