"""The package's queries against their SQL, at a small scale factor."""

import duckdb
import pytest

from gaugeframe.llm.queries import queries
from gaugeframe.llm.sql import oracle_sql

TABLES = "documents pages benchmark labels conversations".split()
SQL = oracle_sql()
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    df = queries()[name](spark, small)
    result = duck.execute(SQL[name])
    header = [d[0] for d in result.description]
    assert {c: TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in result.description}
    found = sorted((tuple(row[c] for c in header) for row in df.collect()), key=str)
    assert found == sorted(result.fetchall(), key=str) and found
