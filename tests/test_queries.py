"""Every registered query of the library against its SQL twin."""

import pytest

import __spark_entry__ as entry_module
from assetlake.plans import registry

from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    if name in registry.ORACLES:
        assert compare(spark, tables, registry.QUERIES[name], registry.ORACLES[name], SF) == ""
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(entry_module.oracle_sql()) and set(registry.QUERIES) <= set(entry_module.queries())
