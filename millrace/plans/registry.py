"""Registry of runnable queries: key -> (function of the tables, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan`` under ``key``; ``sql`` is the equal DuckDB statement."""

    def register(plan: Plan) -> Plan:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = Query(key, plan, sql)
        return plan

    return register
