"""Every query with SQL against DuckDB; every other query has rows here, and its values in test_twins.py or test_core.py."""

import pytest

import __spark_entry__ as entry
from alphaloom import registry
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, data, name):
    bad = differences(registry.QUERIES[name](spark, data), connect(data), registry.ORACLE[name])
    assert not bad, bad[:5]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, data, name):
    rows = registry.QUERIES[name](spark, data).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
