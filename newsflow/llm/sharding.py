"""Shards by proportional stratified interleaving.

Rows are put in a seeded order within their source, and row ``r`` of ``n`` gets the fractional rank
``(r + 1/2) / n``. Sorted by fractional rank all sources advance in proportion, so cutting the order
into equal runs gives every shard the mixture of the whole. Both ranks are computed in buckets of a
uniform key plus prefix sums of bucket counts: a source with most of the rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read, written
from .registry import query

SHARDS = 40
ROWS_PER_BUCKET = 20_000


def seeded(seed: int, *cols):
    """Uniform in [0, 1) from the seed and the columns: 52 bits of an MD5 digest."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2 ** 52)


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 17, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, source, law ('rows'), shard, slot, grown_shard (null).

    Counts of shards differ by one at most. Null text has no bytes; null source is a source of its own.
    Rows that repeat a doc_id follow each other in the order of their text's checksum and size; exact
    repeats are interchangeable. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                               F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.col("source").cast("string").alias("source")), "shard-rows")
    total = rows.count()
    buckets = total // rows_per_bucket + 1
    sizes = rows.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_source")
    tie = [F.col(c) for c in ("doc_id", "text_crc32", "size")]
    by_source = (ranked(rows, tie, seeded(seed, "doc_id", "text_crc32", "size"), ["source"], "_rank", buckets)
                 .join(sizes, F.col("source").eqNullSafe(F.col("_source")), "left")
                 .withColumn("_part", (F.col("_rank") + 0.5) / F.col("_n")).drop("_n", "_source", "_rank"))
    place = ranked(by_source, [F.col("source"), *tie], F.col("_part"), [], "_place", buckets)
    shard = F.floor(F.col("_place") * shards / total).cast("int")
    start = F.ceil(F.col("shard") * total / shards)
    return (place.withColumn("shard", shard).withColumn("slot", (F.col("_place") - start).cast("long"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"))


@query()
def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(read(spark, sf_dir, "documents"))
