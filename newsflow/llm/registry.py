"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tuned(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; small Arrow batches keep long texts within a worker's memory."""
    from ..runtime import prepare
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return prepare(spark)


def query(oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tuned(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return wrap
