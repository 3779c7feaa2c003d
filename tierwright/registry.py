"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Queries on published or generated values alone: checked by the tests, and not part of the registry.
GOLDEN: dict[str, Query] = {}
GOLDEN_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    """Registers a query over given tables under its name with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def golden(sql: str) -> Callable[[Query], Query]:
    """Keeps a query that reads no given table for the tests."""

    def keep(f: Query) -> Query:
        GOLDEN[f.__name__], GOLDEN_SQL[f.__name__] = f, sql
        return f

    return keep
