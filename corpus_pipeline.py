"""Corpus pipeline: quality rules, exact copies, near copies, repeated passages, packing.

``run`` applies the stages to ``documents``; each result is written as Parquet to the shared folder and
read again as the documents of the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.common import read, written
from newsflow.llm.exact_dedup import drop_exact_duplicates
from newsflow.llm.forest_join import keep_first_of_class
from newsflow.llm.packing import pack_documents
from newsflow.llm.quality_rules import keep_good
from newsflow.llm.registry import tuned
from newsflow.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from ``labels``."""
    return keep_good(docs.select(COLUMNS), read(tuned(spark), sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    tuned(spark)
    return drop_exact_duplicates(docs.select(COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the smallest doc_id."""
    tuned(spark)
    return keep_first_of_class(docs.select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, has; every document stays."""
    tuned(spark)
    return remove_repeats(docs.select(COLUMNS), texts=True, carry=["lang", "source"]).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place in it."""
    tuned(spark)
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("suffix-array dedup", passages),
          ("best-fit packing", packed)]
ORACLE_SQL = None  # learned rules, LSH and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
