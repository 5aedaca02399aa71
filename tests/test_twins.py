"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from nichefield import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    ok, text = compare(spark, duck, name, SF)
    assert ok, text


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
