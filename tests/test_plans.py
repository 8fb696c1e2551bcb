"""Plans that must stay as they are: filters and columns reach the scan, no cross joins, top-k without a full sort."""

import pytest

from docspark.catalog import QUERIES
from docspark.plans import inspect

DATA = "/root/testdata/sf0.001"
CARTESIAN = ("CartesianProduct",)


def test_filters_reach_the_scan(spark):
    assert any("GreaterThanOrEqual(ts" in f and "LessThan(ts" in f for f in inspect.pushed_filters(QUERIES["P04_half_open_range"](spark, DATA)))
    assert any("EqualTo(event_type,error)" in f for f in inspect.pushed_filters(QUERIES["O05_last_matches"](spark, DATA)))


def test_only_needed_columns_are_read(spark):
    assert inspect.columns_read(QUERIES["A02_lifecycle_breakdown"](spark, DATA)) == [["o_orderkey", "o_totalprice"]]
    assert inspect.columns_read(QUERIES["A19_user_usage"](spark, DATA)) == [["event_id", "ts", "user_id", "event_type", "value"]] or "props" not in str(inspect.columns_read(QUERIES["A19_user_usage"](spark, DATA)))


@pytest.mark.parametrize("name", ["O02_newest", "O11_claim", "Q01_keyword_search", "A03_top_formats"])
def test_top_k_is_not_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in inspect.physical(QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] in "JL"))
def test_no_cartesian_product(spark, name):
    assert not any(k in inspect.physical(QUERIES[name](spark, DATA)) for k in CARTESIAN)


def test_grouped_sums_are_partial_before_their_shuffle(spark):
    plan = inspect.physical(QUERIES["A16_pipeline_funnel"](spark, DATA))
    assert "partial_count" in plan
