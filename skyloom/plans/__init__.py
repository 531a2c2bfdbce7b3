"""Registered queries of the survey-catalog library."""

from __future__ import annotations

import importlib

MODULES = ("scalar_queries", "join_queries", "aggregate_queries", "quality_queries", "file_queries")


def load() -> tuple[dict, dict]:
    """All queries and their SQL, by id."""
    for name in MODULES:
        importlib.import_module(f"skyloom.plans.{name}")
    from skyloom.plans import registry

    return registry.QUERIES, registry.SQL
