"""Fixity audit of web archives with Merkle trees.

Pages are written as WARC response records, ``RECORDS`` to an archive. The tree of an archive has the
records' SHA-256 digests as leaves; a node hashes the digests of its ``FANOUT`` children together with
the byte range they cover, in offset order. Two replicas are compared at the roots; only below nodes
that differ are children compared, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, written
from .registry import query

RECORDS = 4096
FANOUT = 16
CRLF = "\r\n"


def warc_record(url: Column, page_id: Column, html: Column) -> Column:
    """A WARC/1.1 response record; nulls become empty fields, so every page has a record."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    body = text(html)
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), text(url),
                    F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), text(page_id), F.lit(f">{CRLF}Content-Length: "),
                    F.octet_length(body).cast("string"), F.lit(f"{CRLF}{CRLF}"), body, F.lit(f"{CRLF}{CRLF}"))


def write_archives(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """Write the pages as archives in the shared folder: archive, record_no, page_id, record.

    Archives follow the partitions of the input, so nothing is shuffled and no key can get hot. The
    table is written before it is used, so the numbering stands.
    """
    n = F.monotonically_increasing_id()
    inside = n.bitwiseAND((1 << 33) - 1)
    rows = pages.select((F.shiftright(n, 33) * (1 << 20) + F.floor(inside / records)).alias("archive"), (inside % records).cast("int").alias("record_no"),
                        F.col("page_id").cast("long").alias("page_id"), warc_record(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    return written(rows, "archives")


def leaves(records: DataFrame) -> DataFrame:
    """archive, level 0, node, start, length, hash of every record; offsets run inside an archive."""
    bytes_ = F.encode(F.col("record"), "UTF-8")
    ahead = Window.partitionBy("archive").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return (records.select("archive", F.col("record_no").alias("node"), F.octet_length("record").cast("long").alias("length"), F.sha2(bytes_, 256).alias("hash"))
            .withColumn("start", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
            .select("archive", F.lit(0).alias("level"), "node", "start", "length", "hash"))


def merkle_tree(base: DataFrame, records: int = RECORDS, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots; a group has at most ``fanout`` children."""
    levels, width = [base], records
    while width > 1:
        width = -(-width // fanout)
        kids = F.sort_array(F.collect_list(F.struct("node", "start", "length", "hash")))
        said = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["node"], k["start"], k["length"], k["hash"])), "|")
        levels.append(levels[-1].groupBy("archive", F.floor(F.col("node") / fanout).cast("int").alias("node"))
                      .agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sha2(said, 256).alias("hash"))
                      .select("archive", F.lit(len(levels)).alias("level"), "node", "start", "length", "hash"))
    return levels


def mismatches(primary: list[DataFrame], replica: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """archive, node, state ('corrupt', 'missing', 'extra') of the records that differ.

    Level by level from the roots; a level is read only below the nodes found to differ above it.
    A record that follows a change of length counts only if its own bytes differ.
    """
    found = None
    for depth in range(len(primary) - 1, -1, -1):
        a, b = primary[depth], replica[depth]
        if found is not None:
            up = found.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
            below = lambda t: t.join(up, (t["archive"] == up["_a"]) & (F.floor(t["node"] / fanout) == up["_n"]), "left_semi")  # noqa: E731, B023
            a, b = below(a), below(b)
        a, b = a.select("archive", "node", F.col("hash").alias("ha")), b.select("archive", "node", F.col("hash").alias("hb"))
        found = (a.join(b, ["archive", "node"], "full").filter(~F.col("ha").eqNullSafe(F.col("hb")))
                 .select("archive", "node", F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("corrupt").alias("state")))
    return found


def audit(primary: DataFrame, replica: DataFrame, records: int = RECORDS, fanout: int = FANOUT) -> DataFrame:
    """archive, record_no, page_id, start, length, record_sha256, state ('ok', 'corrupt', 'missing')
    for every record of the primary, and the replica's extra records.

    Inputs: archive, record_no, page_id, record. Empty inputs give no rows.
    """
    sides = [written(leaves(t), "leaves") for t in (primary, replica)]
    bad = mismatches(*(merkle_tree(s, records, fanout) for s in sides), fanout)
    base = (primary.select("archive", F.col("record_no").alias("node"), "page_id")
            .join(sides[0], ["archive", "node"], "left").join(bad, ["archive", "node"], "full"))
    return base.select("archive", F.col("node").alias("record_no"), "page_id", "start", "length", F.col("hash").alias("record_sha256"),
                       F.coalesce("state", F.lit("ok")).alias("state"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, chosen by page_id: changed bytes, truncated and lost records."""
    p = F.col("page_id")
    record = (F.when(p % 101 == 7, F.concat(F.lit("w"), F.expr("substring(record, 2)")))
              .when(p % 211 == 3, F.expr("substring(record, 1, length(record) - 3)")).otherwise(F.col("record")))
    return records.filter((p % 307 != 11) | p.isNull()).withColumn("record", record)


@query(r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'Content-Length: '
  || octet_length(encode(coalesce(html, '')))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages)
SELECT page_id, octet_length(encode(record)) AS length, sha256(record) AS record_sha256,
  CASE WHEN page_id % 307 = 11 THEN 'missing' WHEN page_id % 101 = 7 OR page_id % 211 = 3 THEN 'corrupt' ELSE 'ok' END AS state
FROM r
""")
def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = write_archives(read(spark, sf_dir, "pages"))
    return audit(primary, damaged(primary)).select("page_id", "length", "record_sha256", "state")
