"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from reportmill.jobs import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_equals_sql(spark, db, name):
    got, want = own.QUERIES[name](spark, SF).toPandas(), db.execute(own.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_has_rows(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0
