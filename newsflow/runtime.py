"""Session set-up and the few helpers that touch the cluster directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# recording call sites would dominate the building of long keyword expressions
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def get_session(app: str = "newsflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_CONF, **DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings the operators rely on (UTC, adaptive execution)."""
    for key, value in DEFAULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the context's checkpoint folder, else one below the
    warehouse. On a cluster the last must not be a folder of the driver's machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/newsflow-scratch"
    master = spark.sparkContext.master
    on_one_machine = master.startswith("local") and not master.startswith("local-cluster")
    if not on_one_machine and folder.startswith(("file:", "/")):
        raise ValueError(f"{folder} is not shared with the executors: set spark.checkpoint.dir to a folder that is")
    return folder


def small_rows(df: DataFrame, limit: int) -> list | None:
    """Rows of a dictionary table if it has at most ``limit``; None when it is larger."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows
