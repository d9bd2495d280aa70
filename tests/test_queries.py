"""Every query that has SQL gives the SQL's rows; every other one gives rows."""

import os

import oracle
import pytest
from tidemark.plans import catalogue

DIR = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DIR)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    mine = oracle.spark_rows(catalogue.queries()[name](spark, DIR))
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert oracle.differ(mine, oracle.sql_rows(con, sql)) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
