"""The Spark session of tests, checks and the benchmark."""

from __future__ import annotations

import os

from newsflow.runtime import get_session


def session(cpus: str | None = None):
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = get_session("newsflow", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("OFF")
    return spark
