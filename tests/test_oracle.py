"""Every query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def text(v) -> str:
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0) if v != int(v) else str(int(v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, D).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert entry.queries()[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
