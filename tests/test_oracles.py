"""Every query with an oracle against DuckDB on the small tables, and the entry points."""

import pytest

import __spark_entry__ as entry
from rostrum.plans import registry

from . import compare


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_sql(spark, sf, con, name):
    assert compare.compare(spark, con, sf, registry.QUERIES[name], registry.ORACLE_SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
