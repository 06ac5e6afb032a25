"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.sql(ORACLES[name])
    names = result.columns
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = ordered(tuple(row[i] for i in places) for row in result.fetchall())
    assert ordered(df.select(*[f"`{c}`" for c in columns]).collect()) == expected


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and all(abs(r["negative"] + r["neutral"] + r["positive"] - 100) < 1e-5 for r in rows)
