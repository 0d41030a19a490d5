"""Every registered query against its expected result in DuckDB, on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from oracle.queries import oracle_sql
from veilwright.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_expected_result():
    assert set(oracle_sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert difference(catalog.queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert "resolution_status" in df.columns and df.count() > 0
