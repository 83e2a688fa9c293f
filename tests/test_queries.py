"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestar.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or (not hasattr(x, "__len__") and pd.isna(x)):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    try:
        return repr(float(x) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(cell(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, expected = registry.queries()[name](spark, SMALL).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["dt", "pnl", "names"]


@pytest.mark.parametrize("name", ["online_eg", "online_pamr", "online_olmar", "residual_momentum"])
def test_covers_every_supplier(spark, name):
    large = SMALL.replace("sf0.001", "sf0.01")
    assert registry.queries()[name](spark, large).select("entity").distinct().count() == spark.read.parquet(f"{large}/supplier.parquet").count()
