"""Registered queries, one module for each area, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL if it has one."""

    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in ("event_queries", "dialogue_queries", "document_queries", "table_queries", "file_queries", "session_queries", "stream_queries"):
        import_module(f"parlance.plans.{name}")
