"""Every registered query against its independent SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from merchantscope.plans import driver
from oracle.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
#: The queries of the settlement book; the corpus operators have tests of their own.
QUERIES = {name: entry.queries()[name] for name in driver.all_queries()}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
