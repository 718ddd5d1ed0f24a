"""Every registered query against its oracle, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    frame = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(frame) > 0
    else:
        assert differences(frame, oracle.execute(sql).df()) is None
