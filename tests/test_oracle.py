"""Every registered query against its SQL on the smallest tables (skipped where the tables are absent)."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF_DIR = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not found")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, _rows, _seconds = compare(spark, con, SF_DIR, QUERIES[name], ORACLE.get(name))
    assert ok, message
