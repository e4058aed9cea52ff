"""The named queries and the SQL that states their expected results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.plans import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **tables: str) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL statement when there is one.

    ``tables`` states tables of the statement that are not the bed's, by name.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle.sql(sql, **tables)
        return fn

    return add
