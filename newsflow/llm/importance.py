"""Resampling towards a target distribution with bit-sliced weights.

Every feature (a run of words) falls into a bucket by its CRC-32. A document's bucket counts are cut into
bit planes: plane ``p`` has one bit per bucket, set where bit ``p`` of the count is set. The gain of each
bucket is cut the same way, with a sign plane of negative weight (two's complement). The sum of count times
gain over all buckets is then

    sum over p, q of +-2^(p+q) * popcount(count plane p AND gain plane q)

in exact integers, without a product or a look-up per feature. Corpus counts are one pass that adds counts
per task before the shuffle; weights are a second pass over the texts, so no per-document counts are
stored. The draw cuts the sorted order at the right rank: a table of rows per score gives the lowest score
that can be drawn, and only rows from there on are ordered, by range partitions.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, read, written
from .registry import query
from .shingles import utf8

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
CHUNK_BYTES = 1_000_000
CHUNK_TEXTS = 64
BY_STEP = 48  # features of more bytes are hashed one by one


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True  # of lower-cased text: digits, letters, all bytes of other characters


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices ``data[starts:ends]``, a byte place at a time over all slices that reach it."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, BY_STEP + 1), kind="stable")
    at, size = starts[order], length[order]
    long = int(np.searchsorted(-size, -BY_STEP, side="left"))
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[long]) if long < len(size) else 0):
        last = int(np.searchsorted(-size, -j, side="left"))  # slices of more than j bytes
        now = crc[long:last]
        crc[long:last] = _CRC[(now ^ data[at[long:last] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(long):
        crc[k] = zlib.crc32(data[at[k]:at[k] + size[k]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of bounded size: first, last, their lower-cased bytes and the offsets in them."""
    data, at = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, min(first + CHUNK_TEXTS, int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1))
        yield first, last, _LOWER[data[at[first]:at[last]]], at[first:last + 1] - at[first]
        first = last


def features(b: np.ndarray, at: np.ndarray, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the features of some texts: bucket and text number; and the number of words of each text."""
    texts = len(at) - 1
    inside = _WORD[b]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(b))]  # words end with their text
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    owner = np.searchsorted(at, starts, side="right") - 1
    words = np.bincount(owner, minlength=texts)
    if longest > 1 and len(starts):  # words one space apart
        inside_or_gap = inside.copy()
        joined = np.full(int((ends - starts).sum()) + len(starts), 32, np.uint8)
        shift = np.cumsum(np.append(0, (ends - starts)[:-1] + 1))
        joined[np.repeat(shift - starts, ends - starts) + np.flatnonzero(inside_or_gap)] = b[inside]
        b, starts, ends = joined, shift, shift + (ends - starts)
    found, whose = [], []
    for n in range(shortest, longest + 1):
        k = len(starts) - n + 1
        if k > 0:
            same = owner[:k] == owner[n - 1:]
            found.append(crc32_of(b, starts[:k][same], ends[n - 1:][same]) % np.uint32(buckets))
            whose.append(owner[:k][same])
    none = np.empty(0, np.int64)
    return (np.concatenate(found) if found else none), (np.concatenate(whose) if whose else none), words


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of rows of non-negative integers: [..., bits, words of 64 bits]."""
    cut = np.stack([np.packbits((values >> p) & 1, axis=-1) for p in range(bits)], axis=-2)
    spare = -cut.shape[-1] % 8
    cut = np.concatenate([cut, np.zeros((*cut.shape[:-1], spare), np.uint8)], axis=-1) if spare else cut
    return np.ascontiguousarray(cut).view(np.uint64)


def signed_planes(gains: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Two's complement planes of signed integers and the weight of each plane."""
    bits = max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1
    return planes(gains & ((1 << bits) - 1), bits), [*(1 << q for q in range(bits - 1)), -(1 << (bits - 1))]


def plane_products(counts: np.ndarray, gain_planes: np.ndarray, powers: list[int]) -> np.ndarray:
    """For each row of ``counts`` the sum of count times gain, from ANDed planes."""
    total = np.zeros(len(counts), np.int64)
    for p, plane in enumerate(np.moveaxis(planes(counts, max(int(counts.max(initial=0)).bit_length(), 1)), 1, 0)):
        for gain, power in zip(gain_planes, powers):
            total += np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) * (power << p)
    return total


def bucket_counts(texts: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket; added up per task first."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, b, at in chunks(batch.column("text")):
                total += np.bincount(features(b, at, shortest, longest, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; ``buckets`` numbers come to the driver, whatever the tables' size."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    both = (bucket_counts(docs, shortest, longest, buckets).withColumn("of", F.lit(0))
            .unionByName(bucket_counts(target, shortest, longest, buckets).withColumn("of", F.lit(1))))
    for bucket, n, of in both.collect():
        (s, t)[of][bucket] = n
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (all_s + buckets) / ((float(a) + 1) * (all_t + buckets))))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of a document in thousandths, from a digest of the seed and its id (null: no digits)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, gains: np.ndarray, shortest: int = 1, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gains)
    gain_planes, powers = signed_planes(gains)

    def score(batches):
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
            n_words, n_features, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for first, last, b, at in chunks(text):
                bucket, owner, words = features(b, at, shortest, longest, buckets)
                rows = last - first
                counts = np.bincount(owner * buckets + bucket, minlength=rows * buckets).reshape(rows, buckets)
                n = counts.sum(axis=1)
                n_words[first:last], n_features[first:last] = words, n
                weight[first:last] = np.where(n > 0, plane_products(counts, gain_planes, powers) // np.maximum(n, 1), 0)
            scores = weight + np.array([noise(seed, i) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, scores))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rank`` of the highest scores among rows of at least ``least_words`` words, null for the others.

    ``rows`` is a written table. Scores are whole numbers in a range that does not depend on the number of
    rows, so the table of rows per score is small; rows from the lowest drawn score on are ordered by range.
    """
    able = F.col("n_words") >= least_words
    per_score = rows.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score"))
    cut = (per_score.withColumn("all", F.sum("n").over(Window.partitionBy())).withColumn("above", F.sum("n").over(down) - F.col("n"))
           .withColumn("drawn", F.floor(F.col("all") * percent / 100))
           .filter("above < drawn").agg(F.min("score").alias("score"), F.max("drawn").alias("drawn")).first())
    if cut["score"] is None:  # nothing to draw
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= cut["score"])
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("weight"), F.desc("n_features"), F.asc("_row")]
    ordered = written(rows.filter(near).repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("_part", F.spark_partition_id())
                      .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "drawn")
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n"))
    before = (sizes.withColumn("_before", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))
              .select(F.col("_part").alias("_of"), "_before"))
    place = (F.col("_before") + F.col("_at") + 1).cast("long")
    ranked = (ordered.join(F.broadcast(before), F.col("_part") == F.col("_of"))  # one row per partition
              .withColumn("rank", F.when(place <= cut["drawn"], place)).select(*rows.columns, "rank"))
    return ranked.unionByName(rows.filter(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``.

    Null texts have no words, a null doc_id draws its noise from the empty text and ranks before others of
    its score. Rows that repeat a doc_id have the same noise; exact repeats are interchangeable. Documents of
    fewer than ``least_words`` words get a score but no rank. Without documents there are no rows; without
    target texts the gains are those of an empty target. Other columns are ignored.
    """
    texts = id_and_text(docs)
    gains = bucket_gains(texts, target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), shortest, longest, buckets)
    rows = importance_scores(texts, gains, shortest, longest, seed).withColumn("_row", F.monotonically_increasing_id())
    return draw(written(rows, "importance"), percent, least_words).drop("_row")


@query()
def op13_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
