"""Every registered query against its DuckDB counterpart on the smallest data set."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare, duck  # noqa: E402
from factbase.plans.catalog import duck_queries, spark_queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SLOW_WITHOUT_ORACLE = {"similar_facts", "drop_similar_facts", "consolidate", "consolidation_totals"}  # see test_similar.py


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(spark_queries()) - SLOW_WITHOUT_ORACLE))
def test_query_matches(spark, con, name):
    ok, message = compare(spark, con, SF_DIR, name, spark_queries()[name], duck_queries()[name])
    assert ok, message
