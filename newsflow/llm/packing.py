"""Sum-of-squares packing of token pieces into sequences.

Every document is tokenized in place; only piece lengths travel. Pieces fall at random into groups of
about ``group_tokens`` tokens, and each group is packed on its own, longest pieces first: of
the open sequences that can take a piece, it goes to the one that makes the sum over gaps of (number of
open sequences with that gap) squared smallest; a new sequence is opened when none can. Groups are independent, so the last sequences of each stay part empty, of
the order of one in ten thousand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, read, written
from .registry import query
from .tokens import byte_bpe, tokenizer_path

CAPACITY = 2048
GROUP_TOKENS = 1 << 26
END_ID = 0


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (binary, little-endian unsigned 32 bit).

    A document longer than ``capacity`` is cut so that only its first piece can be shorter. Null text
    counts as empty and has the end id alone.
    """
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    ranks = ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer, ranks)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for n, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start:first if start == 0 else start + capacity].tobytes()
                    rows.append((doc_id, n, start, len(part) // 4, zlib.crc32(part), part))
                    held += len(part)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length, taken in the given order, and the number of sequences."""
    n_open = np.zeros(capacity + 1, dtype=np.int64)  # open sequences per gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        gaps = n_open[size:capacity]
        # change of the sum when a sequence of gap g takes the piece: (g leaves) + (g - size enters)
        change = np.where(gaps > 0, 1 - 2 * gaps + 2 * n_open[:capacity - size] + 1, never)
        if len(change):
            change[0] = 1 - 2 * gaps[0] if gaps[0] > 0 else never  # filled to the end: no gap is left
        at = int(change.argmin()) if len(change) else -1
        if at >= 0 and change[at] != never:
            gap = size + at
            b = bins[gap].pop()
            n_open[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        place[i], offset[i] = b, capacity - gap
        if gap > size:
            bins[gap - size].append(b)
            n_open[gap - size] += 1
    return place, offset, used


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, start, length (at most ``capacity``).

    Equal lengths are taken in the order of doc_id and piece; an empty table gives no rows. ``pieces`` is read twice.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = total // group_tokens + 1

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        place, t["offset"], _ = sum_of_squares(t["length"].to_numpy(), capacity)
        t["sequence_id"] = (t["_group"].to_numpy(np.int64) << 32) + place
        return t.drop(columns="_group")

    keyed = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return keyed.groupBy("_group").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = written(tokenized_pieces(docs).drop("ids"), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
