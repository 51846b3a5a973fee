"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, queries()[name], oracle_sql().get(name))
    assert ok, note


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
