"""Every registered query of the library against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tastemill.plans.oracle import ORACLE
from tastemill.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    value = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


def close(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, int | float) and abs(x - y) < 2e-5) or str(x) == str(y) for x, y in zip(a, b))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for x, y in zip(a, b)), [(x, y) for x, y in zip(a, b) if not close(x, y)][:3]


def test_core_popular_has_every_item(spark, con, tmp_path):
    """Of more than 100,000 items."""
    c = con.cursor()
    c.execute(f"copy (select p.* replace (p_partkey + i * 1000 as p_partkey) from part p, range(501) r(i)) to '{tmp_path}/part.parquet' (format parquet)")
    for name in ("customer", "orders", "lineitem", "events"):
        (tmp_path / f"{name}.parquet").symlink_to(DATA / f"{name}.parquet")
    want = ORACLE["core_popular"].replace("from part ", f"from '{tmp_path}/part.parquet' ")
    a, b = rows(QUERIES["core_popular"](spark, str(tmp_path)).toPandas()), rows(c.execute(want).df())
    assert len(a) == len(b) == 3 * 501 * 200 and all(map(close, a, b))


def test_sketches_are_near(spark):
    r = QUERIES["approx_users_items"](spark, str(DATA)).first()
    assert abs(r["users"] - 150) <= 3 and abs(r["items"] - 200) <= 4


def test_entry(spark):
    import __spark_entry__ as e

    r = e.entry(spark).first()
    assert 0 <= r["precision"] <= 1 and r["n_eval_users"] > 0
