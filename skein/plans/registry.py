"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function by its name, with the SQL that gives the same rows if there is any."""

    def register(made: Query) -> Query:
        QUERIES[made.__name__] = made
        if sql is not None:
            ORACLES[made.__name__] = sql
        return made

    return register
