"""Every core query runs on the smallest tables; those with SQL give what DuckDB gives."""

import math
import os
from datetime import UTC, datetime

import duckdb
import pytest

import __spark_entry__
from sievelode.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in sorted(os.listdir(DATA)):
        con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, datetime) and value.tzinfo:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        result = tables.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
        assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
