"""Queries of the text operators against their statements, and what every one returns."""

import re
from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "documents pages labels benchmark".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_statement(spark, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = database.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == expected


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
