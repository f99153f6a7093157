import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import SF_DIR, compare  # noqa: E402

from hintloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, name):
    rows = queries.QUERIES[name](spark, SF_DIR).count()
    assert rows > 0 or name == "p3_limits"  # the smallest tables are too few for a spike
