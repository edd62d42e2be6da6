"""Every query against DuckDB on the same tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from weftline import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
