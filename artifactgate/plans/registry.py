"""The table of registered queries that the modules of this package fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from artifactgate.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function of (spark, sf_dir), under its name, with the SQL that it is held against."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fixtures.oracle(sql, recursive)
        return f

    return add


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"
