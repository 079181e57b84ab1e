"""Every registered query with an SQL twin gives the same rows."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, ORACLE[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
