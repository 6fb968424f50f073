"""Every query against its SQL on the same tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
# The optional subpackage tests its own queries.
SQL = {name: q for name, q in driver.oracle_sql().items() if not re.match(r"op\d+_|pipeline$", name)}
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def ordered(records):
    return sorted(records, key=lambda r: tuple((v is None, str(v)) for v in r))


def equal(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    df = driver.queries()[name](spark, small)
    names = sorted(df.columns)
    result = duck.execute(SQL[name])
    header = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(header) == names
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    found = ordered(tuple(row[c] for c in names) for row in df.collect())
    expected = ordered(tuple(dict(zip(header, r))[c] for c in names) for r in result.fetchall())
    assert len(found) == len(expected)
    assert found, "an empty result checks nothing"
    for a, b in zip(found, expected):
        assert all(map(equal, a, b)), (a, b)
