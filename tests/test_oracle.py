"""Every query with an oracle agrees with DuckDB on the small tables; the others run."""

import pytest
from oracle import connect, difference

import docspark.catalog as registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees(spark, con, name):
    assert difference(registry.QUERIES[name](spark, DATA), con, registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
