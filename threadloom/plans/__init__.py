"""Registry of the runnable queries and of the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, growing, handoff, rules, stores

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [conversations, handoff, stores, growing, rules]


def all_queries() -> dict[str, Query]:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def all_sql() -> dict[str, str]:
    return {name: materialised(sql) for m in MODULES for name, sql in m.SQL.items()}


def materialised(sql: str) -> str:
    """The steps of a query, each computed once: inlined into each other, their expressions multiply."""
    return re.sub(r"(?m)^(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", sql)
