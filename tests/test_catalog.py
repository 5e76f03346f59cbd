"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from emberframe import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def keys(d):
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, bool, np.number, np.bool_)) else v
    return sorted(repr(tuple(map(plain, r))) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert keys(got) == keys(want)


def test_rows_only(spark):
    assert {x["sim_id"]: x["iou"] for x in catalog.QUERIES["twin_recovery"](spark, SF).collect()}[-1] == 1.0


def test_workers_get_the_package_from_any_folder(tmp_path):
    """A driver that has the package on its own path only, in another working directory."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from emberframe import catalog
print("rows", catalog.QUERIES["twin_recovery"](s, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["emc_by_event"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan and "Exchange" not in plan
