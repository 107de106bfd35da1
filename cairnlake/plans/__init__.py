"""Registered queries: each operator applied to the store's relations, with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Store, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, recursive: bool = False):
    """Register ``f(store)`` under a name, with the oracle's SQL over the named relations."""
    def put(f: Callable[[Store], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql, *views, recursive=recursive)
        return f

    return put


def load() -> None:
    """Import all modules of queries."""
    from . import deduplication, flushes, hierarchy, integrity, journals, listing, maintenance, metadata, payload, scalars, scans, snapshots, streams, writes  # noqa: F401
