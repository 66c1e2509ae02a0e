"""Queries over the driver's tables, by name, each with DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    from . import graph_queries, ingest_queries, relational_queries, text_queries

    return relational_queries.QUERIES | graph_queries.QUERIES | text_queries.QUERIES | ingest_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
