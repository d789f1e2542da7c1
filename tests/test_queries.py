"""Every registered query of the plans that has SQL gives the rows that DuckDB gives over the same tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from leadloom.plans import lead_cases, market_cases, outreach_cases, page_cases, signal_cases, source_cases, stream_cases, table_cases, workflow_cases

TABLES = "/root/testdata/sf0.001"
CASES = [(m, name) for m in (market_cases, lead_cases, outreach_cases, page_cases, source_cases, signal_cases, stream_cases, table_cases, workflow_cases) for name in m.ORACLES]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("module, name", CASES, ids=[name for _, name in CASES])
def test_query_equals_sql(spark, tables, module, name):
    got = module.QUERIES[name](spark, TABLES)
    want = tables.sql(module.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)
