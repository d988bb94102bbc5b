"""Queries over the tables of a data directory, each beside the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def register() -> tuple[Callable[[str, str | None], Callable[[Query], Query]], dict[str, Query], dict[str, str]]:
    """A decorator that names a query and its SQL (None where SQL cannot express it), and the two tables it fills."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[name] = f
            if sql is not None:
                oracles[name] = sql
            return f

        return add

    return query, queries, oracles


def everything() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and all SQL."""
    from cratewave.plans import feedback, inout, library, ranking, series, tagging

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for part in (library, ranking, tagging, feedback, series, inout):
        queries |= part.QUERIES
        oracles |= part.ORACLES
    return queries, oracles
