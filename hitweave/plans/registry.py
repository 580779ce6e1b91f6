"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = dedent(sql)
        return fn

    return register
