"""Helpers shared by the corpus operators: input shape, shared folder, distributed ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import shared_dir

# word separators of all contracts: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text: empty) and the columns of ``carry``, so that others cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(carry or []))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to a new folder of the shared directory and read it back: cuts lineage, survives lost
    executors, and lets later passes read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsflow-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) \
        .otherwise(F.lower(c))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, SPACES), "")


def ranked(df: DataFrame, by: list[Column], spread: Column, within: list[str], out: str, buckets: int) -> DataFrame:
    """Rank from 0 in the order ``(spread, by)`` for each value of ``within``, without a task per value.

    ``spread`` lies in [0, 1) and comes first in the order. Rows are numbered inside buckets of it, and
    the numbers of rows in lower buckets (a small table) are added.
    """
    keys = [F.col(c) for c in within]
    rows = df.withColumn("_spread", spread).withColumn("_bucket", F.floor(F.col("_spread") * buckets))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_spread", *by)))
    before = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = (rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
            .withColumn("_base", F.coalesce(before, F.lit(0))).drop("_n"))
    for c in [*within, "_bucket"]:
        base = base.withColumnRenamed(c, f"_k_{c}")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*within, "_bucket"]]
    return (local.join(base, on, "left")
            .withColumn(out, F.col("_base") + F.col("_local") - 1)
            .drop("_spread", "_bucket", "_local", "_base", *(f"_k_{c}" for c in [*within, "_bucket"])))
