"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``). Equal
sets form a class and take part once, with the class size as weight. Each of ``TREES`` trees orders the
classes by ``DEPTH`` MinHash values; two classes are candidates when the first ``k`` values agree in
some tree, which finds ``1 - (1 - s^k)^TREES`` of the links of strength s. ``k`` starts at the full depth
and is shortened until the weakest link asked for is found with the target's probability; stronger
links are found more surely, so the target holds for links of every strength on any corpus.

A candidate pair belongs to the first tree in which its prefixes agree, so nothing is verified twice.
Prefix groups are cut into blocks of ``BLOCK`` classes and pairs of blocks are the units of work:
pairs exist only as cells of a unit's matrix, verified on whole shingle sets, and a unit hands on counts
and the edges of a spanning forest. Components of those edges are the classes of near copies.

All joins are merge joins: Spark sizes tables after ``explode`` by the rows before it and would send tables
of the corpus' size through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.similarity import connected_components
from .common import discard, id_and_text, read, written
from .registry import query
from .shingles import shingle_sets

TREES = 10
DEPTH = 5
BLOCK = 256
SIMILARITY = 0.8
TARGET = 0.9995
_A = np.random.default_rng(7).integers(1, 2 ** 63, (2, TREES * DEPTH), dtype=np.uint64)
_ODD, _FLIP = _A[0] | np.uint64(1), _A[1]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH values, the upper halves of the smallest hashes."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[i:i + 2048, None] ^ _FLIP) * _ODD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (digest of the shingle set; null without words), n, sig."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("sig", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for s in shingle_sets(batch.column(2)):
                keys.append(set_key(s))
                sizes.append(len(s))
                sigs.append(minhash(s))
            flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * (TREES * DEPTH)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists], schema=schema)

    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, key binary, n int, sig array<int>")


def prefixes(classes: DataFrame, depth: int) -> DataFrame:
    """Add ``prefix``: for each tree a hash of its first ``depth`` values."""
    one = lambda t: F.xxhash64(F.lit(depth), F.lit(t), F.slice("sig", t * DEPTH + 1, depth))
    return classes.withColumn("prefix", F.array(*map(one, range(TREES))))


def crowded(members: DataFrame) -> DataFrame:
    """One row per class and tree whose prefix is not alone: tree, bucket and the columns given."""
    rows = members.select("*", F.posexplode("prefix").alias("tree", "bucket"))
    many = rows.groupBy("bucket").count().filter("count > 1").withColumnRenamed("count", "n_members")
    return rows.join(many.hint("merge"), "bucket")


def recall(strength: float, depth: int) -> float:
    """Probability that a link of this Jaccard similarity is found with prefixes of ``depth`` values."""
    return 1 - (1 - strength ** depth) ** TREES


def choose_depth(classes: DataFrame | None = None, similarity: float = SIMILARITY, target: float = TARGET) -> int:
    """The longest prefix that finds the weakest link asked for with probability ``target``; 1 if none does.

    The choice does not depend on ``classes``: a mix of mostly strong links must not cost the weak ones.
    """
    return next((depth for depth in range(DEPTH, 1, -1) if recall(similarity, depth) >= target), 1)


def units(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of prefix groups dealt to units (bucket, lo, hi); ``here`` is the member's block.

    Groups whose pairs all belong to an earlier tree (every member shares another prefix) are left out.
    """
    rows = crowded(members)
    same = F.lit(False)
    for t in range(TREES):
        same = same | ((F.col("tree") > t) & (F.col(f"lo_{t}") == F.col(f"hi_{t}")))
    alive = (rows.groupBy("bucket", "tree").agg(*(f(F.col("prefix")[t]).alias(f"{n}_{t}") for t in range(TREES) for n, f in (("lo", F.min), ("hi", F.max))))
             .filter(~same).select("bucket"))
    blocks = F.ceil(F.col("n_members") / block).cast("int")
    here = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    return (rows.join(alive.hint("merge"), "bucket").withColumn("blocks", blocks).withColumn("here", here)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", "size", "n", "prefix", "tree", "bucket", "here", F.least("here", "other").alias("lo"), F.greatest("here", "other").alias("hi")))


def _links(sets: list[np.ndarray], prefix: np.ndarray, tree: int, here: np.ndarray, crossing: bool, similarity: float) -> np.ndarray:
    """Symmetric matrix of the verified links of a unit that belong to ``tree``."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    cand = np.minimum.outer(n, n) >= similarity * np.maximum.outer(n, n) - 1e-9
    for t in range(tree):
        cand &= np.not_equal.outer(prefix[:, t], prefix[:, t])
    if crossing:
        cand &= np.not_equal.outer(here, here)
    np.fill_diagonal(cand, False)
    if not cand.any():
        return cand
    busy = np.flatnonzero(cand.any(axis=1))
    flat, back, count = np.unique(np.concatenate([sets[i] for i in busy]), return_inverse=True, return_counts=True)
    column = np.full(len(flat), -1, np.int64)
    shared = np.flatnonzero(count > 1)
    column[shared] = np.arange(len(shared))
    row = np.repeat(np.arange(len(busy)), n[busy])
    column = column[back]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(busy), len(busy)), np.float32)
    for start in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(busy), min(4096, len(shared) - start)), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        common += part @ part.T
    union = np.add.outer(n[busy], n[busy]) - common
    out = np.zeros((m, m), bool)
    out[np.ix_(busy, busy)] = common >= similarity * union - 1e-6
    return out & cand


def _forest(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row."""
    label = np.arange(len(links))
    while True:
        low = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verify(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (key, other, n): with ``other`` null, n documents linked to the class; else an edge."""
    schema = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("n", pa.int64())])

    def unit(rows: list[dict]) -> Iterator[tuple]:
        first = rows[0]
        sets = [np.frombuffer(r["shingles"], "<u8") for r in rows]
        links = _links(sets, np.array([r["prefix"] for r in rows]), first["tree"], np.array([r["here"] for r in rows]), first["lo"] != first["hi"], similarity)
        counts = links @ np.array([r["size"] for r in rows], np.int64)
        label = _forest(links)
        for i in np.flatnonzero(counts).tolist():
            yield rows[i]["key"], None, int(counts[i])
            if label[i] != i:
                yield rows[i]["key"], rows[label[i]]["key"], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["bucket"], r["lo"], r["hi"]) != at:
                    if len(held) > 1:
                        out.extend(unit(held))
                    held, at = [], (r["bucket"], r["lo"], r["hi"])
                held.append(r)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if len(held) > 1:
            out.extend(unit(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    by = ["bucket", "lo", "hi"]
    return members.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "key binary, other binary, n long")


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, shingles (binary, sorted 64-bit hashes) of the classes in ``wanted`` (key, rep, rep_hash)."""
    schema = pa.schema([("key", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, held = [], [], 0
            for key, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                keys.append(key)
                sets.append(s.tobytes())
                held += len(sets[-1])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=schema)
                    keys, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    d = id_and_text(docs).withColumn("rep_hash", F.xxhash64("text"))
    hit = d.join(wanted.hint("merge"), d["doc_id"].eqNullSafe(wanted["rep"]) & (d["rep_hash"] == wanted["rep_hash"]))
    return hit.select("key", "text").mapInArrow(run, "key binary, shingles binary").dropDuplicates(["key"])


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, class_id (smallest doc_id of the near-copy class), n_links, is_first.

    ``n_links`` counts the other rows whose shingle set has a Jaccard similarity of ``similarity`` or
    more, copies included. Rows without words are classes of their own without links. ``is_first`` is
    true for one row of each class, with the smallest doc_id (null is smaller). Repeated rows are copies.
    """
    sigs = written(signatures(docs), "signatures")
    rep = F.min(F.struct("doc_id", "text_hash"))
    classes = written(sigs.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"), rep.alias("rep"))
                      .select("key", "size", "n", "sig", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash")), "classes")
    depth = choose_depth(classes, similarity, target)
    work = written(units(prefixes(classes, depth).select("key", "size", "n", "prefix"), block), "units")
    wanted = classes.join(work.select("key").distinct().hint("merge"), "key", "left_semi").select("key", "rep", "rep_hash")
    sets = written(candidate_sets(docs, wanted), "shingle-sets")
    found = written(verify(work.join(sets.hint("merge"), "key"), similarity), "links")
    discard(work, sets)
    parts = connected_components(found.filter("other IS NOT NULL"), "key", "other")
    linked = found.filter("other IS NULL").groupBy("key").agg(F.sum("n").alias("linked"))
    part = classes.join(parts.withColumnRenamed("node", "key").hint("merge"), "key").select("key", "component", "rep")
    lowest = part.groupBy("component").agg(F.min("rep").alias("lowest"), F.max(F.col("rep").isNull()).alias("has_null"))
    info = (classes.select("key", "size", "rep").join(linked.hint("merge"), "key", "left").join(part.select("key", "component").hint("merge"), "key", "left")
            .join(lowest.hint("merge"), "component", "left")
            .select("key", "size", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "key").alias("part"),
                    F.when(F.col("component").isNull(), F.col("rep")).when(~F.col("has_null"), F.col("lowest")).alias("class_id")))
    rows = sigs.select("doc_id", "text_hash", "key").join(info.hint("merge"), "key", "left")
    alone = F.col("key").isNull()
    out = rows.select("doc_id", "text_hash", "part", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.lit(0)).otherwise(F.col("linked") + F.col("size") - 1).cast("long").alias("n_links"))
    # only rows that carry the class's smallest doc_id are ranked; more than one of them are repeats
    top = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("part").isNotNull()
    first = F.row_number().over(Window.partitionBy("part").orderBy("text_hash")) == 1
    return (out.filter(~top).withColumn("is_first", F.col("part").isNull())
            .unionByName(out.filter(top).withColumn("is_first", first)).drop("part"))


def keep_first_of_class(docs: DataFrame) -> DataFrame:
    """One row of each near-copy class, with all its columns; rows without words stay."""
    found = near_copies(docs).filter("is_first").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).dropDuplicates()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(found.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_hash")), "left_semi")


@query()
def op1_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
