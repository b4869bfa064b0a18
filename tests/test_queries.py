"""Every registered query against its SQL on the smallest tables, and the entry points."""

import pytest

import __spark_entry__ as entry
from cohortis.plans import queries as registry
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_entry_has_all():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
