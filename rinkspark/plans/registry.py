"""Registry of named queries: a Spark builder plus, where SQL can say the
same thing, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            # Same tie-proof 4-place rounding as the Spark side.
            from rinkspark.plans.rounding import sql_round4

            ORACLES[name] = sql_round4(sql)
        return fn

    return deco
