"""Every query of the library against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from gatehouse.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return db


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return str(v) if isinstance(v, datetime.datetime) else v


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    wanted = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    rows = duck.sql(f"select {','.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(([plain(v) for v in r] for r in rows), key=str)
