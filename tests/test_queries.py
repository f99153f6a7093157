import pytest
from oracle import SF_DIR, compare

import __spark_entry__
from hintloom.plans import core_queries, registry

assert core_queries


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_points(spark):
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
