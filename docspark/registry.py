"""Every query of the document-corpus operators, with its oracle SQL.

``@query(name, sql)`` registers a function of Tables; the SQL may use the adapted
tables of docspark.sources.tables by name, whose definitions are put before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_tables(sql: str) -> str:
    """The SQL with the definitions of all adapted tables it names, directly or through others."""
    named: dict[str, str] = {}

    def add(text: str) -> None:
        for name in SQL:
            if name not in named and re.search(rf"\b{name}\b", text):
                add(SQL[name])
                named[name] = SQL[name]

    add(sql)
    if not named:
        return sql
    head = ", ".join(f"{n} AS ({t})" for n, t in named.items())
    rest = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if rest:
        return f"WITH {rest[1] or ''}{head}, {sql[rest.end():]}"
    return f"WITH {head} {sql}"


def query(name: str, sql: str | None = None):
    """Register a query of Tables under its name, with its oracle if SQL can express it."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return register

