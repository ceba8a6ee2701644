"""Every registered query at the smallest scale against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences, types_of

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name not in SQL:
        assert df.columns and df.count() >= 0
        return
    assert types_of(df, SQL[name], con) == []
    assert differences(df, SQL[name], con) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
