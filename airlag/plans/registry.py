"""Query registry: each entry pairs a Spark query with its plain-SQL twin.

A query is ``fn(spark, sf_dir) -> DataFrame`` reading the driver tables (or
data Spark derives from them).  ``sql`` is the equivalent DuckDB SQL over the
same tables, or None where only a row-count check is possible (model fits,
sampling-based operators).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql
        return fn
    return deco
