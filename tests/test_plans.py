"""Every plan that has a comparison query gives its rows, on the smallest tables."""

import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from cinderspark.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 9)
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_plan_equals_sql(spark, duck, name):
    got = registry.plans[name](spark, str(DATA)).toPandas()
    assert rows(got) == rows(duck.execute(registry.sql[name]).df())


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["area_name", "colour", "problems", "dnbr_median", "pct_burned", "dnbr_p90", "n_unresolved"]
    assert frame.count() >= 0


def test_every_query_is_named_once():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.sql) <= set(registry.plans)
    assert os.path.basename(__spark_entry__.__file__) == "__spark_entry__.py"
