"""Registered queries against their oracles in DuckDB, on the smallest tables."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from dendra.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    q = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(q.columns)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [q.columns.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None


def test_no_cartesian_products(spark):
    for name in ("relation_distribution", "unmatched_audit", "near_duplicates", "projectivity"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
