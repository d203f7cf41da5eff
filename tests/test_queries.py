"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from motifloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(row):
    return tuple("-" if v is None else f"{float(v):.4f}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(plain, found.select(order).fetchall()))
    assert sorted(plain(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
