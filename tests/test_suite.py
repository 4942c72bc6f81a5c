"""Every registered relational query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from millrace import suite

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in suite.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", suite.queries())
def test_query_equals_its_sql(spark, duck, name):
    found = suite.queries()[name](spark, DATA)
    expected = duck.execute(suite.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    left = sorted(tuple(r[c] for c in columns) for r in found.collect())
    right = sorted(expected.fetchall())
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=0.011) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(suite.queries()) <= set(__spark_entry__.queries()) and set(suite.oracle_sql()) <= set(__spark_entry__.oracle_sql())
