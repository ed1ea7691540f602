"""Every registered query against its DuckDB equivalent on the smoke tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalogue.ORACLE:
        want = con.sql(catalogue.ORACLE[name])
        assert table(df.columns, rows) == table(want.columns, want.fetchall())


def test_oracles_have_queries():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
