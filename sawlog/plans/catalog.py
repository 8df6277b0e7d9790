"""The queries over the test tables, each with an independent SQL form where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, recursive: bool = False):
    """Register a query; ``views`` are the common table expressions its SQL starts with."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            head = ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(views) if views else ""
            ORACLE[name] = f"{head}\n{sql}".strip()
        return function

    return add


def load() -> None:
    """Import the modules that register queries."""
    from sawlog.plans import (  # noqa: F401
        queries_alerts, queries_files, queries_health, queries_lines, queries_parse, queries_scalar, queries_streams, queries_tables,
    )
