"""Token ids as Re-Pair grammars.

Documents in doc_id order are encoded to ids and gathered into blocks of about ``BLOCK_TOKENS``. In a
block the most frequent pairs of neighbouring symbols are replaced by nonterminals, round after round,
until no pair is frequent. A block file holds the rules, the length every symbol expands to, the
reduced sequence and an index of documents: lengths summed over the sequence locate any token, so a
document is decoded without its predecessors. Blocks are rows of a table in the shared folder, written
by Spark's committer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, read, written
from .registry import query
from .tokens import tokenizer_path, word_bpe

BLOCK_TOKENS = 1 << 20
END_ID = 1
VOCABULARY = 49_408
SYMBOLS = 1 << 16
RULES_A_ROUND = 8_000
LEAST_COUNT = 16
MAGIC = b"RPG1"
_SLOTS = 1 << 20


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(12)


def frequent_pairs(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur ``least`` times or more, and how often."""
    pairs, counts = np.unique(codes, return_counts=True)
    often = counts >= least
    return pairs[often], counts[often]


def repair(ids: np.ndarray, first_rule: int = VOCABULARY, rules_a_round: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule k writes symbol ``first_rule + k`` for two earlier symbols.

    Each round replaces the most frequent pairs together, from left to right where they overlap, until no pair
    occurs ``least`` times or the symbols run out. A replaced pair is gone, and other old pairs only become
    rarer; so after a round that took every frequent pair only pairs with a new symbol are counted. Of two
    pairs in one slot the rarer waits for the next round.
    """
    seq, rules, n_rules, fresh = ids.astype(np.uint16), [], 0, 0
    while len(seq) > 1 and (room := min(rules_a_round, SYMBOLS - first_rule - n_rules)) > 0:
        where = None
        if fresh:
            new = seq >= fresh
            where = np.flatnonzero(new[:-1] | new[1:])
        left, right = (seq[:-1], seq[1:]) if where is None else (seq[where], seq[where + 1])
        codes = left.astype(np.uint32) << np.uint32(16) | right
        pairs, counts = frequent_pairs(codes, least)
        if not len(pairs):
            break
        chosen = pairs[np.argsort(-counts, kind="stable")][:room]
        _, one = np.unique(_slot(chosen), return_index=True)  # the more frequent of two pairs in a slot
        chosen = chosen[np.sort(one)]
        table = np.full(_SLOTS, -1, np.int32)
        table[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        rule = table[_slot(codes)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[chosen[rule[hit]] == codes[hit]]
        at, rule = hit if where is None else where[hit], rule[hit]
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        run_start = np.repeat(starts, np.diff(np.append(starts, len(at))))
        first = (np.arange(len(at)) - run_start) % 2 == 0
        at = at[first]
        seq[at] = first_rule + n_rules + rule[first]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(chosen)
        fresh = first_rule + n_rules if len(chosen) == len(pairs) else 0
        n_rules += len(chosen)
    flat = np.concatenate(rules) if rules else np.empty(0, np.uint32)
    return np.stack([flat >> np.uint32(16), flat & np.uint32(0xFFFF)], axis=1).astype(np.uint16), seq


def pack_block(ids: np.ndarray, doc_tokens: np.ndarray, first_rule: int = VOCABULARY) -> bytes:
    """The bytes of a block file: header, rules, expansion lengths, sequence, tokens of each document."""
    rules, seq = repair(ids, first_rule)
    lengths = np.ones(first_rule + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[first_rule + k] = lengths[a] + lengths[b]
    return b"".join([MAGIC, struct.pack("<IIIII", first_rule, len(rules), len(seq), len(ids), len(doc_tokens)), rules.astype("<u2").tobytes(),
                     lengths[first_rule:].astype("<u4").tobytes(), seq.astype("<u2").tobytes(), doc_tokens.astype("<u4").tobytes()])


class Block:
    """A block file, decoded as a whole or by ranges of tokens."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block file")
        self.first_rule, n_rules, n_seq, self.n_tokens, n_docs = struct.unpack_from("<IIIII", data, 4)
        at = 24
        parts = []
        for count, kind in ((2 * n_rules, "<u2"), (n_rules, "<u4"), (n_seq, "<u2"), (n_docs, "<u4")):
            parts.append(np.frombuffer(data, kind, count, at))
            at += count * int(kind[2])
        self.rules, self.lengths, self.seq, self.doc_tokens = parts[0].reshape(-1, 2), *parts[1:]
        self.ends = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that symbols stand for; nonterminals are replaced from the youngest rule down."""
        known: dict[int, bytes] = {}

        def text(s: int) -> bytes:
            if s < self.first_rule:
                return struct.pack("<H", s)
            if s not in known:
                a, b = self.rules[s - self.first_rule].tolist()
                known[s] = text(a) + text(b)
            return known[s]

        used, back = np.unique(symbols, return_inverse=True)
        parts = [text(s) for s in used.tolist()]
        return np.frombuffer(b"".join([parts[i] for i in back.tolist()]), "<u2")

    def decode(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """``n`` ids from token ``start`` on; only the symbols that cover them are expanded."""
        n = self.n_tokens - start if n is None else n
        if self.ends is None:
            rule = self.seq >= self.first_rule
            size = np.ones(len(self.seq), np.int64)
            size[rule] = self.lengths[self.seq[rule].astype(np.int64) - self.first_rule]
            self.ends = np.cumsum(size)
        if n <= 0:
            return np.empty(0, "<u2")
        a, b = np.searchsorted(self.ends, [start, start + n - 1], side="right")
        skip = start - (int(self.ends[a - 1]) if a else 0)
        return self.expand(self.seq[a:b + 1])[skip:skip + n]


def write_blocks(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The table of block files: shard, block, n_tokens, doc_ids, data; ascending (shard, block) is
    ascending doc_id (null first). Rows with one doc_id are ordered by text; null text is empty."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block = word_bpe(path), TaskContext.get().partitionId(), 0
        end, doc_ids, parts, held = struct.pack("<H", end_id), [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.array([len(p) // 2 for p in parts], np.uint32)
            data = pack_block(np.frombuffer(b"".join(parts), "<u2"), tokens)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, block, held // 2, doc_ids, data), schema.types)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                parts.append(encoder.encode(text.as_py()) + end)
                held += len(parts[-1])
                if held >= 2 * block_tokens:
                    yield flush()
                    doc_ids, parts, held, block = [], [], 0, block + 1
        if parts:
            yield flush()

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "shard int, block int, n_tokens long, doc_ids array<long>, data binary"), "grammar-blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["data"])
                ids = b.decode().astype("<u4")
                ends = np.cumsum(b.doc_tokens, dtype=np.int64)
                starts = ends - b.doc_tokens
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = (row["doc_ids"], [row["base"]] * len(crc), starts, b.doc_tokens, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    # tokens before a block: per shard first, then inside the shard; both tables hold counts only
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.select("shard", "block", "n_tokens")
    shards = counts.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead(F.lit(0), "shard")), F.lit(0)))
    bases = (counts.join(shards.drop("n"), "shard").withColumn("base", F.col("before") + F.coalesce(F.sum("n_tokens").over(ahead("shard", "block")), F.lit(0)))
             .select("shard", "block", "base"))
    rows = blocks.select("shard", "block", "doc_ids", "data").join(bases, ["shard", "block"]).select("base", "doc_ids", "data")
    return (rows.mapInArrow(run, "doc_id long, base long, start long, n_tokens long, ids_crc32 long")
            .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


@query()
def op10_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(write_blocks(read(spark, sf_dir, "documents")))
