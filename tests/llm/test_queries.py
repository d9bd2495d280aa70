import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402
from tidemark.llm import queries as Q  # noqa: E402

DIR = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name):
    mine = oracle.spark_rows(Q.queries()[name](spark, DIR))
    if name in Q.oracle_sql():
        assert oracle.differ(mine, oracle.sql_rows(oracle.connect(DIR), Q.oracle_sql()[name])) == ""
