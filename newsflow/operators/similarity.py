"""Similarity joins: set similarity by size blocks and matrices, cosine by pivot cells, components.

Both joins are exact. Rows that are copies of each other are expected to be collapsed by the
caller (one row per distinct token set or vector), so a group of copies costs one row here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import checkpoint

DENSE_SHARE = 0.0027
DENSE_TOKENS = 2048
CHUNK_CELLS = 1 << 22


def overlap_chunks(a_sizes: np.ndarray, a_codes: np.ndarray, b_sizes: np.ndarray, b_codes: np.ndarray, step: int | None = None):
    """(first row, matrix of shared tokens) for the sets of ``a``, ``step`` rows at a time, against all sets of ``b``.

    Sets are given by their sizes and the codes of their tokens one after the other. Tokens that many pairs
    share are columns of a matrix product; the others are looked up in a list of the sets that hold them.
    """
    n_a, n_b = len(a_sizes), len(b_sizes)
    if not len(a_codes) or not len(b_codes):
        return
    n = int(max(a_codes.max(), b_codes.max())) + 1
    held = np.bincount(b_codes, minlength=n)
    work = np.bincount(a_codes, minlength=n) * held
    common = np.flatnonzero(work > DENSE_SHARE * n_a * n_b)
    common = common[np.argsort(-work[common], kind="stable")[:DENSE_TOKENS]]
    place = np.full(n, -1)
    place[common] = np.arange(len(common))

    def dense(rows: np.ndarray, codes: np.ndarray, count: int) -> np.ndarray:
        at = place[codes]
        m = np.zeros((count, len(common)), dtype=np.float32)
        m[rows[at >= 0], at[at >= 0]] = 1
        return m

    b_rows = np.repeat(np.arange(n_b), b_sizes)
    right = dense(b_rows, b_codes, n_b).T
    listed, starts = b_rows[np.argsort(b_codes, kind="stable")], np.cumsum(held) - held
    ends = np.cumsum(a_sizes)
    step = step or max(1, CHUNK_CELLS // n_b)
    for first in range(0, n_a, step):
        last = min(n_a, first + step)
        codes = a_codes[ends[first] - a_sizes[first]:ends[last - 1]]
        rows = np.repeat(np.arange(last - first), a_sizes[first:last])
        shared = dense(rows, codes, last - first) @ right
        rare = (place[codes] < 0) & (held[codes] > 0)
        times = held[codes[rare]]
        turn = np.arange(int(times.sum())) + np.repeat(starts[codes[rare]] - np.cumsum(times) + times, times)
        np.add.at(shared.reshape(-1), np.repeat(rows[rare] * n_b, times) + listed[turn], np.float32(1))
        yield first, shared


def token_codes(*columns: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sizes and token codes of each column of token lists; equal tokens have equal codes in all of them."""
    lists = [c.combine_chunks() for c in columns]
    tokens = pa.chunked_array([x.flatten() for x in lists]).combine_chunks()
    codes = np.asarray(tokens.dictionary_encode().indices).astype(np.int64)
    sizes = [np.asarray(x.value_lengths().fill_null(0)).astype(np.int64) for x in lists]
    cuts = np.cumsum([int(s.sum()) for s in sizes])[:-1]
    return list(zip(sizes, np.split(codes, cuts)))


HITS = 1 << 20
MARKS = 1 << 24


def sorted_sets(sizes: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of each set in rising order."""
    rows = np.repeat(np.arange(len(sizes)), sizes) * n
    return np.sort(rows + codes) - rows


def bitmaps(sizes: np.ndarray, codes: np.ndarray, words: int) -> np.ndarray:
    """(words, sets): the tokens of each set as bits; tokens may share a bit."""
    bits = np.zeros((len(sizes), words * 64), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), codes * 40503 % (words * 64)] = True
    return np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


def similar_sets(a_sizes: np.ndarray, a_codes: np.ndarray, b_sizes: np.ndarray, b_codes: np.ndarray, threshold: float,
                 alone: bool = False):
    """(rows of a, rows of b, shared tokens) of all pairs whose Jaccard similarity can reach the threshold.

    Tokens are ordered from rare to common. Sets that reach the threshold share one of their first tokens, and
    the first such token leaves enough behind it in both (prefix and position). Of those pairs, bitmaps bound the
    shared tokens, and what passes is counted. With ``alone`` both sides are the same and pairs have a < b.
    """
    if not len(a_codes) or not len(b_codes):
        return
    n = int(max(a_codes.max(), b_codes.max())) + 1
    held = np.bincount(a_codes, minlength=n) + np.bincount(b_codes, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(n)
    share = threshold / (1 + threshold)
    sides = []
    for sizes, codes in ((a_sizes, rank[a_codes]), (b_sizes, rank[b_codes])):
        codes = sorted_sets(sizes, codes, n)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = at < (sizes - np.ceil(threshold * sizes - 1e-9) + 1)[rows]
        sides.append((codes, rows[first], codes[first], (sizes[rows] - at)[first].astype(np.float32), (share * sizes - 0.005).astype(np.float32)))
    (a_all, a_rows, a_first, a_left, a_share), (b_all, b_rows, b_first, b_left, b_share) = sides
    order = np.argsort(b_first, kind="stable")
    listed, left = b_rows[order], b_left[order]
    count = np.bincount(b_first, minlength=n)
    starts = np.cumsum(count) - count
    words = 1 << max(0, math.ceil(math.log2(max(1.0, np.percentile(b_sizes, 90) / 16))))
    a_bits, b_bits = bitmaps(a_sizes, a_all, words), bitmaps(b_sizes, b_all, words)
    apart = np.float32(1 - 2 * share)
    a_starts, b_starts = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    hits = np.cumsum(np.bincount(a_rows, count[a_first], len(a_sizes)))
    at = np.searchsorted(a_rows, np.arange(len(a_sizes) + 1))
    first, most = 0, max(1, MARKS // n)
    marks = np.zeros(min(most, len(a_sizes)) * n, bool)
    while first < len(a_sizes):
        done = hits[first - 1] if first else 0
        last = min(first + most, max(first + 1, int(np.searchsorted(hits, done + HITS, side="right"))))
        last = min(last, len(a_sizes))
        entries = slice(at[first], at[last])
        times = count[a_first[entries]]
        turn = np.arange(int(times.sum())) + np.repeat(starts[a_first[entries]] - np.cumsum(times) + times, times)
        i, j = np.repeat(a_rows[entries], times), listed[turn]
        good = np.minimum(np.repeat(a_left[entries], times), left[turn]) >= a_share[i] + b_share[j]
        if alone:
            good &= i < j
        i, j = i[good], j[good]
        differ = np.zeros(len(i), np.uint16)
        for x, y in zip(a_bits, b_bits):
            differ += np.bitwise_count(x[i] ^ y[j])
        good = differ <= (a_sizes[i] + b_sizes[j]) * apart + np.float32(0.01)
        i, j = np.divmod(np.unique(i[good] * len(b_sizes) + j[good]), len(b_sizes))
        mine = slice(a_starts[first], a_starts[last - 1] + a_sizes[last - 1])
        marked = np.repeat(np.arange(last - first), a_sizes[first:last]) * n + a_all[mine]
        marks[marked] = True
        for k in range(0, len(i), HITS >> 4):
            x, y = i[k:k + (HITS >> 4)], j[k:k + (HITS >> 4)]
            sizes = b_sizes[y]
            begin = np.cumsum(sizes) - sizes
            codes = b_all[np.arange(int(sizes.sum())) + np.repeat(b_starts[y] - begin, sizes)]
            yield x, y, np.add.reduceat(marks[codes + np.repeat((x - first) * n, sizes)], begin, dtype=np.int64)
        marks[marked] = False
        first = last


TOKEN_END = "\n"
SET_BLOCKS = 16
BLOCK_SETS = (1024, 32768)


def token_set_pairs(sets: DataFrame, key: str, tokens: str, threshold: float,
                    block: str | None = None) -> DataFrame:
    """(a, b, sim) with a < b for all pairs of rows whose token Jaccard reaches ``threshold``.

    ``block`` restricts to pairs in the same or neighbouring integer blocks. Tokens have no line feeds.

    Sets are ordered by size and cut into homes of at most ``BLOCK_SETS`` sets. Each pair of homes whose sizes can
    reach the threshold is one group that finds its pairs by rare tokens (``similar_sets``), so only pairs that
    reach the threshold are ever rows, and what a task holds does not grow with the input. The work still grows with
    the square of the number of sets of a like size, but only by those that share a rare token.
    """
    # one string a set: many times cheaper to shuffle and to hand to Python than an array of strings
    rows = sets.select(F.col(key).alias("k"), F.array_join(tokens, TOKEN_END).alias("t"), F.size(tokens).alias("size"),
                       (F.col(block) if block else F.lit(0)).cast("bigint").alias("blk")).filter("size > 0")
    rows = checkpoint(rows)
    least, most = BLOCK_SETS
    per_home = max(least, min(most, math.ceil(rows.count() / SET_BLOCKS)))
    counts = rows.groupBy("blk", "size").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("blk").orderBy("size")) - F.col("n")
    homes = rows.join(counts.withColumn("before", before), ["blk", "size"]).withColumn(
        "no", F.floor((F.col("before") + F.pmod(F.xxhash64("k"), F.col("n"))) / per_home)).select(
        "k", "t", "size", F.struct("blk", "no").alias("home"))
    spans = checkpoint(homes.groupBy("home").agg(F.min("size").alias("lo"), F.max("size").alias("hi")))
    one = spans.select(F.col("home").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
                       F.explode(F.array("home.blk", F.col("home.blk") + 1) if block else F.array("home.blk")).alias("blk"))
    other = spans.select(F.col("home").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), "home.blk")
    meet = one.join(other, "blk").filter(
        "a <= b" + f" and hi_a >= lo_b * {threshold!r}D - 1e-9 and hi_b >= lo_a * {threshold!r}D - 1e-9").select("a", "b")
    sides = meet.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("home"), "a", "b")
    kind = sets.schema[key].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        keys = group["k"].combine_chunks()
        number = np.asarray(group["first"])
        alone = not (number == 2).any()
        left, right = np.flatnonzero(number == 1), np.flatnonzero(number == (1 if alone else 2))
        (a_sizes, a_codes), (b_sizes, b_codes) = token_codes(*(pc.split_pattern(group["t"].take(pa.array(x)), TOKEN_END) for x in (left, right)))
        out = []
        for i, j, shared in similar_sets(a_sizes, a_codes, b_sizes, b_codes, threshold, alone):
            both = shared.astype(np.float64)
            sim = both / (a_sizes[i] + b_sizes[j] - both)
            good = sim >= threshold
            out.append((left[i[good]], right[j[good]], sim[good]))
        a, b, sim = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b)), "sim": pa.array(sim, pa.float64())})

    # 1 for the sets of the first home, 2 for those of the second
    met = homes.join(sides, "home").select("k", "t", F.when(F.col("home") == F.col("a"), 1).otherwise(2).alias("first"), "a", "b")
    found = met.groupBy("a", "b").applyInArrow(compare, f"a {kind}, b {kind}, sim double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


# --- cosine ------------------------------------------------------------------------------------
BLOCK_ROWS = 4096
BLOCK_CELLS = 1 << 21


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def unit(vector: Column) -> Column:
    """Vector scaled to length one (Arrow batches; the result is materialised once per row)."""
    @F.pandas_udf("array<double>")
    def scale(v: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(v)))
    return scale(vector)


def _pivots(vectors: DataFrame, key: str, vector: str, count: int) -> list[list[float]]:
    """A fixed number of vectors chosen by key hash; bounded driver data."""
    rows = (vectors.select(key, vector, F.xxhash64(key).alias("h")).orderBy("h", key).limit(count)
            .select(vector).collect())
    return [list(r[0]) for r in rows]


def _cells(pivots: list[list[float]], reach: float):
    """Arrow function: vector -> (nearest pivot, pivots a partner may belong to)."""
    centres = _matrix(pd.Series(pivots))

    @F.pandas_udf("struct<home: int, cells: array<int>>")
    def assign(v: pd.Series) -> pd.DataFrame:
        u = _matrix(v)
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ centres.T)))
        near = d <= d.min(axis=1, keepdims=True) + 2 * reach + 1e-9
        return pd.DataFrame({"home": d.argmin(axis=1).astype("int32"),
                             "cells": [np.flatnonzero(r).astype("int32") for r in near]})
    return assign


def cosine_matches(queries: DataFrame, store: DataFrame, threshold: float, query_id: str = "id",
                   store_id: str = "id", vector: str = "embedding",
                   pivots: int = 16, best: int | None = None) -> DataFrame:
    """(query_id, match_id, score) for every pair with cosine >= threshold, identities left out.

    With ``best`` a block returns only that many best matches of each query (ties to the smaller match_id), which are
    enough for the best of all blocks.

    Unit vectors are split into cells around pivots; the triangle inequality says which cells
    can hold a partner, so no pair is missed. A crowded cell is cut into blocks of about
    ``BLOCK_CELLS`` numbers a side, ``BLOCK_ROWS`` rows at least, that are multiplied in separate tasks. Each
    vector goes to every block of the other side as it was given: the shuffle grows with rows x rows / rows a block.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    s = store.select(F.col(store_id).alias("match_id"), F.col(vector).alias("v"))
    centres = _pivots(s, "match_id", "v", pivots)
    if not centres:
        return s.select(F.col("match_id").alias("query_id"), "match_id", F.lit(0.0).alias("score")).limit(0)
    assign = _cells(centres, reach)
    per_block = max(BLOCK_ROWS, BLOCK_CELLS // max(1, len(centres[0])))
    probe = q.withColumn("c", assign("v")).select("query_id", F.col("v").alias("qv"), F.col("c.home").alias("cell"))
    build = s.withColumn("c", assign("v")).select("match_id", F.col("v").alias("sv"), F.explode("c.cells").alias("cell"))
    kinds = {f.name: f.dataType.simpleString() for f in [*probe.schema.fields, *build.schema.fields]}

    def blocks(side: DataFrame) -> Column:  # one count per cell; there are at most ``pivots``
        rows = side.groupBy("cell").count().collect()
        table = F.create_map(*[F.lit(x) for r in rows for x in (r["cell"], math.ceil(r["count"] / per_block))]) \
            if rows else F.create_map().cast("map<int,int>")
        return F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(0))

    np_, nb_ = blocks(probe), blocks(build)
    left = (probe.withColumn("p", F.pmod(F.xxhash64("query_id"), np_))
            .withColumn("b", F.explode(F.sequence(F.lit(1), nb_))).filter("b > 0"))
    right = (build.withColumn("b", F.pmod(F.xxhash64("match_id"), nb_) + 1)
             .withColumn("p", F.explode(F.sequence(F.lit(0), np_ - 1))).filter("p >= 0")
             .withColumn("b", F.col("b").cast("int")).withColumn("p", F.col("p").cast("bigint")))

    def best_of(u: np.ndarray, v: np.ndarray, queries: np.ndarray, stored: np.ndarray, step: int) -> pd.DataFrame:
        """The best match of each query in its block, ties to the smaller match_id (the first)."""
        lo, hi = np.searchsorted(stored, queries, "left"), np.searchsorted(stored, queries, "right")
        best_at, value = np.empty(len(u), np.int64), np.empty(len(u))
        for first in range(0, len(u), step):
            scores = u[first:first + step] @ v
            for i in first + np.flatnonzero(hi[first:first + step] > lo[first:first + step]):
                scores[i - first, lo[i]:hi[i]] = -np.inf  # itself
            j = scores.argmax(axis=1)
            best_at[first:first + step], value[first:first + step] = j, scores[np.arange(len(j)), j]
        good = value >= threshold
        return pd.DataFrame({"query_id": pd.Series(queries[good], dtype=queries.dtype),
                             "match_id": pd.Series(stored[best_at[good]], dtype=stored.dtype), "score": value[good]})

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "match_id": [], "score": []})
        b = b.sort_values("match_id", kind="stable")
        queries, stored = a["query_id"].to_numpy(), b["match_id"].to_numpy()
        u, v = _matrix(a["qv"]), _matrix(b["sv"]).T
        step = max(1, BLOCK_CELLS // len(stored))
        if best == 1 and np.isfinite(v).all() and not (a["query_id"].hasnans or b["match_id"].hasnans):
            return best_of(u, v, queries, stored, step)
        out = []
        for first in range(0, len(u), step):
            scores = u[first:first + step] @ v
            i, j = np.nonzero(scores >= threshold)
            value, i = scores[i, j], i + first
            other = queries[i] != stored[j]
            i, j, value = i[other], j[other], value[other]
            if best is not None:
                order = np.lexsort((j, -value, i))
                i, j, value = i[order], j[order], value[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < best
                i, j, value = i[top], j[top], value[top]
            out.append((i, j, value))
        i, j, value = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": pd.Series(queries[i], dtype=queries.dtype), "match_id": pd.Series(stored[j], dtype=stored.dtype),
                             "score": value})

    return (left.groupBy("cell", "p", "b").cogroup(right.groupBy("cell", "p", "b"))
            .applyInPandas(multiply, f"query_id {kinds['query_id']}, match_id {kinds['match_id']}, score double"))


def similar_topk(queries: DataFrame, store: DataFrame, threshold: float, k: int, **cols) -> DataFrame:
    from .windows import top_per_key
    hits = cosine_matches(queries, store, threshold, best=k, **cols)
    return top_per_key(hits, ["query_id"], [F.desc("score"), "match_id"], k, rank="rank")


def max_similarity(queries: DataFrame, store: DataFrame, threshold: float = 0.0, **cols) -> DataFrame:
    hits = cosine_matches(queries, store, threshold, best=1, **cols)
    return hits.groupBy("query_id").agg(F.max("score").alias("max_similarity"))


def pair_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Cosine of two vector columns."""
    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_matrix(x) * _matrix(y)).sum(axis=1))
    return pairs.withColumn(out, cosine(a, b))


def history_threshold(score: float) -> float:
    """Cosine that corresponds to a store score of (1 + cosine) / 2."""
    return 2 * score - 1


# --- components --------------------------------------------------------------------------------
def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node of each component, by star contraction.

    Each round joins every edge with the minimum of its neighbourhood, so the number of rounds
    grows with the logarithm of the longest chain. Nodes without edges are not returned. Joins are
    merge joins, so that no table of nodes goes through the driver.
    """
    links = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                       .filter("u <> v").distinct())

    def mark(edges_now: DataFrame) -> tuple:
        """Number and hash sum of the edges: equal only if a round changed nothing."""
        h = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(edges_now.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    before = mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (both.join(lowest.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .filter("u <> v").distinct())
        small_low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (big.join(small_low.hint("merge"), "u").filter("v <> m")
                 .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(small_low.select("u", F.col("m").alias("v"))).distinct())
        links = checkpoint(small)
        now = mark(links)
        if now == before:
            break
        before = now
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
