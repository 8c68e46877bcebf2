"""Every query against its SQL on the small tables: names, types, rows and values."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    assert difference(df, con, ORACLE[name]) is None
    types = {r[0]: r[1] for r in con.sql("DESCRIBE " + ORACLE[name]).fetchall()}
    assert {n: TYPES.get(t) for n, t in df.dtypes} == types


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
