"""Registry of queries: name -> (spark, sf_dir) -> DataFrame, and the equivalent SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = re.sub(r"@(\w+)", r"\1", sql)  # @name is a table of the data folder, see plans.given
        return f

    return add


def _load() -> None:
    from . import plans  # noqa: F401


_load()
