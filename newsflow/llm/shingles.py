"""Five-word shingles of Arrow text columns, hashed in numpy without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK_BYTES = 2_000_000

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64)
_STEP = np.uint64(int(_rng.integers(1, 2 ** 63)) | 1)
_WORD = _rng.integers(1, 2 ** 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the offsets of its values."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its shingles.

    A text of one to four words has one shingle, all of it; a text without words has none.
    """
    data, at = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1)
        yield from _chunk(data[at[first]:at[last]], at[first:last + 1] - at[first], size)
        first = last


def _chunk(b: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    none = np.empty(0, np.uint64)
    inside = ~_SPACE[b]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[at[:-1][at[:-1] < len(b)]] = inside[at[:-1][at[:-1] < len(b)]]  # words end with their text
    starts = np.flatnonzero(begin)
    if not len(starts):
        yield from (none for _ in range(len(at) - 1))
        return
    where = np.zeros(len(b), np.int64)  # place of a byte in its word
    where[starts[0]:] = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    value = _BYTE[b] * _powers(int(where.max()) + 1)[where]
    value[~inside] = 0
    words = mix(np.add.reduceat(value, starts))
    doc_of = np.searchsorted(at, starts, side="right") - 1
    ends = np.searchsorted(doc_of, np.arange(len(at) - 1), side="right")
    begins = np.append(0, ends[:-1])
    n = len(words) - size + 1
    rolled = sum((words[j:j + n] * _WORD[j] for j in range(size)), np.zeros(max(n, 0), np.uint64)) if n > 0 else none
    rolled = mix(rolled)
    for s, e in zip(begins.tolist(), ends.tolist()):
        if e - s >= size:
            yield np.unique(rolled[s:e - size + 1])
        elif e > s:
            short = words[s:e] * _WORD[:e - s]
            yield mix(np.array([short.sum(dtype=np.uint64) ^ np.uint64(e - s)], np.uint64))
        else:
            yield none
