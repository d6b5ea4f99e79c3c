"""Every registered query of the engine against its DuckDB twin at the smallest scale."""

import pytest

from tessera.plans import registry
from tests.check_oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLES:
        assert difference(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name]) is None
    else:
        rows = registry.QUERIES[name](spark, SF)
        assert rows.columns and rows.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
