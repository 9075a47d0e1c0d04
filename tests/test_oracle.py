"""Every query with SQL gives the same rows on Spark and DuckDB (smallest tables)."""

import os
import sys

import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")


@pytest.fixture(scope="module")
def con():
    import check_oracle
    return check_oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    import check_oracle
    message = check_oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert message.startswith("ok"), message


def test_every_query_has_a_name_in_the_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
