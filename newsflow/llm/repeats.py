"""Repeated passages by a run-length compressed index.

A byte goes when some ``LENGTH``-byte string that covers it starts earlier in the corpus as well.

1. Later copies of a text are repeats from end to end and take no further part.
2. Every string of LENGTH bytes names one of its ``KGRAM``-byte substrings, the one with the smallest
   hash (leftmost on ties). The strings of a document that name the same place form a context. Equal
   strings name equal substrings, so repeats can only be found between contexts of one anchor hash.
   Anchors that occur once, in one text, are dropped before any text moves.
3. Contexts meet by anchor. Of equal ones the first stays; every string of the others is a repeat.
   The distinct contexts of whole anchors are indexed in batches: a Burrows-Wheeler transform, kept as
   runs with the text position and the common prefix sampled at the ends of adjoining runs. Between
   samples the length of the match with the neighbour in suffix order falls by one per byte, so the
   matching statistics of all positions are streamed from the samples; neighbours that match over
   LENGTH bytes are one string, and all but its earliest start are marked.
4. Anchors with more than ``HOT`` occurrences do not meet in one task: their strings are compared by
   digest with an aggregation that combines before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, read, written
from .registry import query
from .shingles import mix, utf8

LENGTH = 100
KGRAM = 32
HOT = 30_000  # so the text of an anchor that meets in one task stays below about 5 MB
SEGMENT = 1 << 20  # string starts handled at once
BATCH_BYTES = 1 << 20  # text of one index
_PLACE = np.uint64((1 << 22) - 1)
_SEPARATOR = 0xFF  # no byte of UTF-8
_rng = np.random.default_rng(100)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64)
_FACTOR = _rng.integers(1, 2 ** 63, 8, dtype=np.uint64) | np.uint64(1)


def _kgrams(b: np.ndarray) -> np.ndarray:
    """Hash of the KGRAM bytes from each position on (KGRAM is a power of two)."""
    h, width, level = _BYTE[b], 1, 0
    while width < KGRAM:
        h = h[:-width] * _FACTOR[level] + h[width:]
        width, level = 2 * width, level + 1
    return mix(h)


def contexts(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string start, number of strings, anchor hash) of the contexts of texts ``b[bounds[i]:bounds[i+1]]``."""
    none = np.empty(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none
    h = _kgrams(b)
    v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span = LENGTH - KGRAM + 1
    low, width = v, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        rest = span - width
        low = np.minimum(low[:-rest], low[rest:])
    valid = np.zeros(len(low) + 1, np.int32)
    begin, end = bounds[:-1], bounds[1:]
    long = end - begin >= LENGTH
    np.add.at(valid, begin[long], 1)
    np.add.at(valid, end[long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(start):
        return none, none, none
    place = (low[start] & _PLACE).astype(np.int64)
    text = np.searchsorted(bounds, start, side="right")
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return start[first], np.diff(np.append(first, len(start))), h[place[first]].view(np.int64)


def _segments(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, bounds, number of the first text, offset in it): short texts together, long ones in parts
    that overlap so that every string start is in one part."""
    data, at = utf8(column)
    i = 0
    while i < len(column):
        if at[i + 1] - at[i] > SEGMENT + LENGTH - 1:
            for off in range(0, int(at[i + 1] - at[i]) - LENGTH + 1, SEGMENT):
                part = data[at[i] + off:min(at[i] + off + SEGMENT + LENGTH - 1, at[i + 1])]
                yield part, np.array([0, len(part)]), i, off
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, side="right")) - 1)
        while j > i + 1 and at[j] - at[j - 1] > SEGMENT + LENGTH - 1:
            j -= 1
        yield data[at[i]:at[j]], at[i:j + 1] - at[i], i, 0
        i = j


def _keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc: a 64-bit key of the row. It may collide; doc_id and text_hash tell such rows apart."""
    return id_and_text(docs, carry).withColumn("text_hash", F.xxhash64("text")).withColumn("doc", F.xxhash64("doc_id", "text_hash"))


def anchors(keyed: DataFrame) -> DataFrame:
    """text_hash, anchor, own (whether the text has the anchor more than once); distinct per row."""
    schema = pa.schema([("text_hash", pa.int64()), ("anchors", pa.list_(pa.int64())), ("own", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), [[] for _ in range(batch.num_rows)]
            for b, bounds, first, _ in _segments(batch.column(1)):
                start, _, anchor = contexts(b, bounds)
                cut = np.searchsorted(start, bounds)
                for k in range(len(bounds) - 1):
                    if cut[k + 1] > cut[k]:
                        parts[first + k].append(anchor[cut[k]:cut[k + 1]])
            found = [np.unique(np.concatenate(x), return_counts=True) if x else (np.empty(0, np.int64), np.empty(0, np.int64)) for x in parts]
            at = pa.array(np.append(0, np.cumsum([len(x) for x, _ in found])).astype(np.int32))
            flat = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
            often = np.concatenate([n for _, n in found]) > 1 if found else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat, pa.int64())),
                                              pa.ListArray.from_arrays(at, pa.array(often, pa.bool_()))], schema=schema)

    lists = keyed.select("text_hash", "text").mapInArrow(run, "text_hash long, anchors array<long>, own array<boolean>")
    return lists.select("text_hash", F.explode(F.arrays_zip("anchors", "own")).alias("a")).select("text_hash", F.col("a.anchors").alias("anchor"), "a.own")


def repeated_anchors(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """text_hash, wanted, hot_ones: anchors that other texts, or other places of the text, have too, and
    those of them that occur very often."""
    group = Window.partitionBy("anchor")
    rows = (anchors(keyed).withColumn("n", F.count("*").over(group))
            .withColumn("wide", (F.min("text_hash").over(group) != F.max("text_hash").over(group)) | F.max("own").over(group)).filter("wide"))
    return rows.groupBy("text_hash").agg(F.collect_set("anchor").alias("wanted"), F.collect_set(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot_ones"))


CONTEXT = "anchor long, doc_id long, text_hash long, doc long, start long, strings int, context binary"


def candidate_contexts(keyed: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The contexts, with their bytes, of the anchors in ``column`` of ``wanted`` (doc, and lists of anchors)."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()),
                        ("strings", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, text_hash, doc, texts, want = batch.columns
            for b, bounds, first, shift in _segments(texts):
                start, strings, anchor = contexts(b, bounds)
                cut = np.searchsorted(start, bounds)
                ok = np.zeros(len(start), bool)
                for k in range(len(bounds) - 1):
                    ok[cut[k]:cut[k + 1]] = np.isin(anchor[cut[k]:cut[k + 1]], want[first + k].values.to_numpy())
                start, strings, anchor = start[ok], strings[ok], anchor[ok]
                if not len(start):
                    continue
                row = np.searchsorted(bounds, start, side="right") - 1
                whole = b.tobytes()
                bytes_ = [whole[x:y] for x, y in zip(start.tolist(), (start + strings + LENGTH - 1).tolist())]
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), doc_id.take(take), text_hash.take(take), doc.take(take), pa.array(start - bounds[row] + shift),
                                                  pa.array(strings.astype(np.int32)), pa.array(bytes_, pa.binary())], schema=schema)

    rows = keyed.join(wanted.filter(F.size(column) > 0), "doc").select("doc_id", "text_hash", "doc", "text", column)
    return rows.mapInArrow(run, CONTEXT)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text with samples at run ends.

    ``sample_at`` are the text positions whose suffix heads a run, ``sample_lcp`` their common prefix
    with the suffix before (which ends the run before).
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.order = _suffix_order(text)
        last = text[self.order - 1]  # the transform; position 0 has the final separator before it
        head = np.ones(n, bool)
        head[1:] = last[1:] != last[:-1]
        head[np.flatnonzero(self.order == 0)] = True
        self.runs, self.run_starts = last[head], np.flatnonzero(head)
        at = self.order[self.run_starts]
        before = self.order[self.run_starts - 1]
        lcp = _common_prefix(text, at, before)
        lcp[0] = 0  # the first suffix has none before it
        by_place = np.argsort(at, kind="stable")
        self.sample_at, self.sample_lcp, self.n = at[by_place], lcp[by_place], n

    def matching_statistics(self) -> np.ndarray:
        """For every position the length of its match with the suffix before it in suffix order."""
        gap = np.diff(np.append(self.sample_at, self.n))
        return np.repeat(self.sample_lcp + self.sample_at, gap) - np.arange(self.n)

    def strings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in suffix order, and where a new string of ``length`` bytes begins among them."""
        return self.order, np.flatnonzero(self.matching_statistics()[self.order] < length)


def _suffix_order(text: np.ndarray, packed_bits: int = 64) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that ends is smaller.

    Sorts (rank, next rank, place) packed in one number where they fit, else by a stable argsort.
    """
    n = len(text)
    bits = np.uint64(max(1, n.bit_length()))
    place, mask = np.arange(n, dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1)
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    depth = max(1, min(5, (64 - int(bits)) // 8))
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = key << np.uint64(8) | padded[j:j + n]
    while True:
        if 3 * int(bits) <= packed_bits:
            packed = np.sort(key << bits | place)
            order = (packed & mask).astype(np.int64)
            key = packed >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1])).astype(np.uint64)
        if rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.uint64)
        follow[:n - depth] = rank[depth:] + np.uint64(1)
        key = rank << bits | follow
        depth *= 2


def _common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, eight bytes at a time."""
    n = len(text)
    padded = np.append(text, np.zeros(16, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        differ = words[np.minimum(x, n)] != words[np.minimum(y, n)]
        step = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        step = np.minimum(step, n - np.maximum(x, y))
        out[open_] += step
        open_ = open_[(step == 8)]
    return out


def _mark(rows: list[tuple]) -> Iterator[tuple]:
    """(doc, doc_id, text_hash, from, to) of the repeated strings of distinct contexts of whole anchors.

    rows: (doc_id, text_hash, doc, start, strings, context)
    """
    text = np.frombuffer(b"".join(r[5] + b"\xff" for r in rows), np.uint8)
    size = np.array([len(r[5]) + 1 for r in rows])
    base = np.cumsum(size) - size
    turn = np.empty(len(rows), np.int64)
    turn[sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1], rows[i][3]))] = np.arange(len(rows))
    owner = np.repeat(np.arange(len(rows)), size)
    offset = np.arange(len(text)) - base[owner]
    when = turn[owner] * int(size.max()) + offset
    order, new = RunLengthIndex(text).strings(LENGTH)
    earliest = np.repeat(np.minimum.reduceat(when[order], new), np.diff(np.append(new, len(order))))
    again = np.zeros(len(text), bool)
    again[order] = when[order] > earliest
    again &= offset < np.array([r[4] for r in rows])[owner]
    p = np.flatnonzero(again)
    if not len(p):
        return
    cut = np.flatnonzero((np.diff(p, prepend=-2) != 1) | (np.diff(owner[p], prepend=-1) != 0))
    for s, e in zip(p[cut].tolist(), p[np.append(cut[1:], len(p)) - 1].tolist()):
        doc_id, text_hash, doc, start = rows[owner[s]][:4]
        yield doc, doc_id, text_hash, start + int(offset[s]), start + int(offset[e]) + LENGTH


SPAN = "doc long, doc_id long, text_hash long, from long, to long"


def indexed_repeats(found: DataFrame) -> DataFrame:
    """Spans of repeated strings between the contexts of each anchor."""
    schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held, out = [], 0, []
        group, anchor, last = {}, None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[1:5]
                if row[0] != anchor:
                    if len(group) > 1:  # a single distinct context has nothing more to match
                        whole.extend(group.values())
                        held += sum(map(len, group))
                    group, anchor, last = {}, row[0], None
                    if held >= BATCH_BYTES:
                        out.extend(_mark(whole))
                        whole, held = [], 0
                if key == last:  # the same place of a repeated row
                    continue
                last = key
                if row[6] in group:
                    out.append((row[3], row[1], row[2], row[4], row[4] + row[5] + LENGTH - 1))
                else:
                    group[row[6]] = row[1:]
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if len(group) > 1:
            whole.extend(group.values())
        if whole:
            out.extend(_mark(whole))
        if out:
            yield batch_of(out)

    rows = found.select("anchor", "doc_id", "text_hash", "doc", "start", "strings", "context")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_hash", "start").mapInArrow(run, SPAN)


def digested_repeats(found: DataFrame) -> DataFrame:
    """The same by digests of single strings: one row per string, combined to its earliest start."""
    string = F.explode(F.transform(F.sequence(F.lit(0), F.col("strings") - 1), lambda i: F.struct(
        (F.col("start") + i).alias("start"), F.unhex(F.sha2(F.substring("context", i + 1, F.lit(LENGTH)), 256)).alias("digest"))))
    rows = found.select("doc_id", "text_hash", "doc", string.alias("s")).select("doc_id", "text_hash", "doc", "s.start", "s.digest")
    earliest = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("start") == F.col("first.start"))
    return (rows.join(earliest, "digest").filter(~first)
            .select("doc", "doc_id", "text_hash", F.col("start").alias("from"), (F.col("start") + LENGTH).alias("to")))


def repeated_spans(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, doc_id, text_hash, from, to: byte ranges covered by repeated strings; ranges may overlap."""
    rows = written(keyed.select("doc", "doc_id", "text_hash", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n")), "copies")
    firsts = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    copies = (rows.join(firsts, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("n") >= LENGTH))
              .select("doc", "doc_id", "text_hash", F.lit(0).cast("long").alias("from"), F.col("n").alias("to")))
    owners = firsts.select(F.col("first.text_hash").alias("text_hash"), F.xxhash64("first.doc_id", "first.text_hash").alias("doc"))
    wanted = written(repeated_anchors(keyed, hot).join(owners, "text_hash").groupBy("doc").agg(F.first("wanted").alias("wanted"), F.first("hot_ones").alias("hot_ones"))
                     .select("doc", F.array_except("wanted", "hot_ones").alias("wanted"), "hot_ones"), "repeated-anchors")
    spans = indexed_repeats(candidate_contexts(keyed, wanted, "wanted")).unionByName(copies)
    if not wanted.filter(F.size("hot_ones") > 0).isEmpty():
        spans = spans.unionByName(digested_repeats(candidate_contexts(keyed, wanted, "hot_ones")))
    return spans


RESULT = "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, hot: int = HOT, texts: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``texts`` also
    ``kept_text``, in which a character that lost bytes is dropped. ``carry`` names string columns to pass on.

    Null text is empty. A null doc_id is smaller than any other; rows with one doc_id and different
    texts are ordered by a hash of the text; rows equal in both are one document and get equal results.
    """
    carry = carry or []
    keyed = _keyed(docs)
    spans = (repeated_spans(keyed, hot).groupBy("doc")
             .agg(F.collect_list(F.struct("doc_id", "text_hash", "from", "to")).alias("spans")))
    more = [*(["kept_text"] if texts else []), *carry]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *(pa.string() for _ in more)]
    names = ["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text_hash, text, found, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                b = text.encode("utf-8")
                parts, at, runs = [], 0, 0
                end = -1
                for s, e in sorted((x["from"], x["to"]) for x in found or () if x["doc_id"] == doc_id and x["text_hash"] == text_hash):
                    if s > end:
                        runs += 1
                        parts.append(b[at:s])
                        at = end = e
                    else:
                        at = end = max(end, e)
                parts.append(b[at:])
                kept = b"".join(parts)
                rows.append((doc_id, text_hash, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest(), 
                             *([kept.decode("utf-8", "ignore")] if texts else []), *rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], schema=schema)

    passed = _keyed(docs, carry) if carry else keyed
    joined = passed.join(spans, "doc", "left").select("doc_id", "text_hash", "text", "spans", *carry)
    return joined.mapInArrow(run, RESULT + "".join(f", {c} string" for c in more))


@query()
def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("text_hash")
