"""Every registered query with oracle SQL against DuckDB on the smallest tables, and the entry points."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyloom.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    value = value.item() if isinstance(value, np.generic) else value
    if hasattr(value, "year"):
        return str(value)[:10]
    return round(value, 3) + 0.0 if isinstance(value, float) else value


def table(df):
    return sorted((tuple(map(plain, row)) for row in df[sorted(df.columns)].itertuples(index=False)), key=lambda row: (str([v for v in row if not isinstance(v, float)]), str(row)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, small, duck, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = table(got), table(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or isinstance(u, float) and abs(u - v) <= 2e-3 * max(1, abs(v)), (x, y)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["period", "wmape", "bounded_mape", "n_days"]


def test_learned_queries_run(spark, small):
    for name in ("registered_forecaster", "tsb_search", "streaming_state", "fuzzy_rank"):
        assert catalog.QUERIES[name](spark, small).count() > 0
