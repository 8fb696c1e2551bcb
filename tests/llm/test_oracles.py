"""Queries of this subpackage that SQL can express agree with DuckDB on the small tables."""

import pytest
from oracle import connect, difference

from docspark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees(spark, name):
    assert difference(QUERIES[name](spark, DATA), connect(DATA), ORACLE_SQL[name]) == ""
