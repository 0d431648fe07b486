"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import connect, rows_of
from tests.helpers import DATA

QUERIES = entry._queries()
ORACLE = entry._oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
