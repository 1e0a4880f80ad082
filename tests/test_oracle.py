"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()
QUERIES = __spark_entry__.queries()


def plain(value):
    if isinstance(value, float):
        return round(value, 8)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 8)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
