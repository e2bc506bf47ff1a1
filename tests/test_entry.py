"""The registry holds together, and the flagship query runs on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
