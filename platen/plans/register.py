"""Registration of queries: a function of the views, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platen.sources.derived import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views under name; sql is what DuckDB runs for the same rows, where it can."""

    def put(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return build

    return put
