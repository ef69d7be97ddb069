"""Every registered query against its statement on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.TEXT_QUERIES)))
def test_query(spark, database, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert rows, "a query without rows shows nothing"
    statement = entry.oracle_sql().get(name)
    if statement is None:
        return
    result = database.execute(statement)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(shown(r[i]) for i in places) for r in result.fetchall())
    assert len(rows) == len(expected)
    different = [(a, b) for a, b in zip(rows, expected) if a != b]
    assert not different, different[:3]


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
