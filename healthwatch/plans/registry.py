"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result is SQL-expressible, the equivalent DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from healthwatch.plans.fixture_sql import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco
