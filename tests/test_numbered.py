"""Global row numbers in two levels against brute force, and the queries on them."""

import random

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

import docspark.catalog as registry
from docspark.operators import maintenance, windows
from docspark.plans import inspect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_places_and_context(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randrange(5) if i % 3 else None, rng.choice(["error", "click", "view", "view", "view", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, ts long, kind string")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.id: r.place for r in windows.numbered(df, "ts", "id").collect()} == {r[0]: i for i, r in enumerate(want)}
    near = {want[j][0] for i, r in enumerate(want) if r[2] == "error" for j in range(max(0, i - 3), min(n, i + 4))}
    assert {r.id for r in maintenance.near_hits(df, F.col("kind") == "error", "ts", "id").collect()} == near


def test_context_of_all_users(spark):
    sql = "SELECT event_id AS id FROM events QUALIFY BOOL_OR(event_type = 'error') OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    assert difference(registry.QUERIES["W11b_diff_context_all"](spark, DATA), connect(DATA), sql) == ""


def test_stability_has_no_limit(spark):
    assert "Limit" not in inspect.physical(registry.QUERIES["A12b_memory_stability"](spark, DATA))
