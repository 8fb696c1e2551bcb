"""What a query's physical plan does: operators, shuffles, pushed filters, columns read."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each operator stands in the plan."""
    names = re.findall(r"^[\s:+\-*()\d]*(?:\*\(\d+\) )?([A-Z]\w+)", physical(df), re.M)
    return Counter(names)


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df))


def columns_read(df: DataFrame) -> list[list[str]]:
    """The columns of each scan."""
    return [[c.split(":")[0] for c in s.split(",")] for s in re.findall(r"ReadSchema: struct<([^>]*)>", physical(df))]
