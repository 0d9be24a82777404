"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OWNER: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Views`` as a named query."""
    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        OWNER[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load_all() -> None:
    from . import queries_checks, queries_field, queries_layout, queries_linkage, queries_review  # noqa: F401
