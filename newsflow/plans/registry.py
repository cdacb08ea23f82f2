"""Named queries and, where SQL can express them, the equivalent SQL for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when there is one."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        from ..runtime import prepare
        label = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[label] = run
        if oracle:
            ORACLES[label] = oracle
        return fn
    return wrap
