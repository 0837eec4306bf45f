"""Registered queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("q_aggregate", "q_compare", "q_sqltext", "q_samples", "q_retrieval", "q_safety", "q_io")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its DuckDB text over the named views."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql.strip()
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        importlib.import_module(f"tallyspark.plans.{module}")
