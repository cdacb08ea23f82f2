"""Exact duplicates with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after lower-casing A-Z. A Misra-Gries type summary (the frequent-items
sketch behind ``approx_top_k``) nominates frequent digests in one mergeable pass; an exact count
verifies them. The verified winners, at most ``summary`` rows, are broadcast and removed on the map
side, so a group that holds a third of the corpus is never shuffled. The remaining digests are
shuffled as usual; each of those groups has less than ``1 / share`` of the rows unless the summary
missed it, which costs time but not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, lower_ascii, read, written
from .registry import query

SUMMARY = 1000
SHARE = 2000


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the SHA-256 of the normalised text."""
    d = id_and_text(docs)
    return d.select("doc_id", F.unhex(F.sha2(lower_ascii(F.col("text")), 256)).alias("digest"))


def frequent_digests(rows: DataFrame, summary: int = SUMMARY, share: int = SHARE) -> DataFrame:
    """Verified winners: digest, group_size, keep_id and how many rows carry keep_id (``n_top``).

    ``rows`` (doc_id, digest) is read twice; the result has at most ``summary`` rows.
    """
    nominated = (rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {summary}, {8 * summary})").alias("top"), F.count("*").alias("n_rows"))
                 .select("n_rows", F.explode("top").alias("t"))
                 .select("n_rows", F.col("t.item").alias("hash"))
                 .limit(summary))
    counted = (rows.join(F.broadcast(nominated), F.xxhash64("digest") == F.col("hash"))
               .groupBy("digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.max("n_rows").alias("n_rows")))
    return counted.filter(F.col("group_size") >= F.greatest(F.lit(2), F.col("n_rows") / share)).drop("n_rows")


def exact_groups(docs: DataFrame, summary: int = SUMMARY, share: int = SHARE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Null text counts as empty. A null doc_id is smaller than any other. Of rows that tie on the largest
    doc_id exactly one is kept. An empty table gives no rows.
    """
    rows = written(digests(docs), "digests")
    winners = written(frequent_digests(rows, summary, share), "winners")  # at most `summary` rows
    heavy = rows.join(F.broadcast(winners), "digest")
    # the rows of a winner that carry its keep_id: one, or exact repeats of it
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.lit(0))) == 1
    heavy = (heavy.filter(~top).withColumn("kept", F.lit(False))
             .unionByName(heavy.filter(top).withColumn("kept", first)))
    group = Window.partitionBy("digest")
    rest = (rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
            .withColumn("kept", F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id"))) == 1)
            .withColumn("keep_id", F.max("doc_id").over(group))
            .withColumn("group_size", F.count("*").over(group)))
    cols = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    return heavy.select(*cols).unionByName(rest.select(*cols))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; repeated rows are left once."""
    digest = F.sha2(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)
    kept = (exact_groups(docs).filter("kept")
            .select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_digest"),
                    (F.col("group_size") > 1).alias("_many")))
    hit = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_keep")) & (digest == F.col("_digest")))
    # equal doc_id and text can only repeat inside a group
    n = F.row_number().over(Window.partitionBy("_keep", "_digest").orderBy(F.lit(0)))
    many = hit.filter("_many").withColumn("_n", n).filter("_n = 1").drop("_n")
    return hit.filter(~F.col("_many")).unionByName(many).select(*docs.columns)


@query("""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
""")
def op5_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))
