"""Queries by id, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(t) where t(view name) gives a DataFrame."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda v: view(spark, sf_dir, v))
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register
