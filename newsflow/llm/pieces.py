"""SentencePiece BPE by an agenda of adjacent pairs, checked against the library.

A text is normalised as the model says (here: blanks become U+2581, one is put in front) and cut before
each U+2581 that follows another character; no piece of such a vocabulary crosses these cuts, which is
verified when the model is loaded. In a segment the agenda holds the adjacent symbol pairs that form a
piece; the best score, leftmost on ties, is merged until none is left, and unknown characters fall back
to bytes. The new short segments of a chunk of texts run their agendas side by side, one row of pair
scores each; long ones use a heap. Every Arrow batch is encoded by the library as well; ``agrees`` tells whether the ids are
equal, and where they are not the library's count.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, read
from .registry import query
from .tokens import CACHE_WORDS, tokenizer_path

SPACE = "▁"
CHUNK_CHARS = 500_000
SIDE_BY_SIDE = 32  # longest segment, in characters, that is merged in rows
KNOWN_SEGMENTS = 2 * CACHE_WORDS
_NEVER = np.inf


class PieceAgenda:
    def __init__(self, path: str):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.score = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in ids
                      if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.unknown = sp.unk_id()
        self.has_bytes = any(sp.is_byte(i) for i in ids)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.segments = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, str] = {}
        self.written = [f"{i}," for i in range(sp.get_piece_size())]
        # every way to form a piece from two: key of the pair, score and id of the piece
        pairs = {}
        for piece, (cost, i) in self.score.items():
            for cut in range(1, len(piece)):
                a, b = self.score.get(piece[:cut]), self.score.get(piece[cut:])
                if a and b:
                    pairs[a[1] << 32 | b[1]] = (cost, i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_cost = np.array([*(pairs[k][0] for k in self.pair_keys.tolist()), _NEVER])
        self.pair_piece = np.array([*(pairs[k][1] for k in self.pair_keys.tolist()), -1], np.int64)
        self.char_piece = np.full(0x110000, -1, np.int64)
        for piece, (_, i) in self.score.items():
            if len(piece) == 1:
                self.char_piece[ord(piece)] = i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and piece of pairs of ids; no piece: never."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        at = np.where((right >= 0) & (left >= 0) & (self.pair_keys[at] == key), at, len(self.pair_keys)) if len(self.pair_keys) else np.zeros(key.shape, np.int64)
        return self.pair_cost[at], self.pair_piece[at]

    def merge_rows(self, segments: list[str]) -> list[str]:
        """Decimal ids of short segments, by agendas side by side; a character that is no piece is its
        code point below -1 and stays alone."""
        size = np.array([len(s) for s in segments])
        width = int(size.max()) + 1
        sym = np.full((len(segments), width), -1, np.int64)
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        known = self.char_piece[codes]
        sym[np.arange(width) < size[:, None]] = np.where(known >= 0, known, -2 - codes)
        before = np.tile(np.arange(-1, width - 1), (len(segments), 1))
        after = np.tile(np.minimum(np.arange(1, width + 1), width - 1), (len(segments), 1))  # the last column is empty
        cost = np.full((len(segments), width), _NEVER)
        piece = np.full((len(segments), width), -1, np.int64)
        r, c = np.nonzero(sym[:, 1:] >= 0)
        cost[r, c], piece[r, c] = self._pairs(sym[r, c], sym[r, c + 1])
        rows = np.arange(len(segments))
        while len(rows):
            best = cost[rows].argmin(axis=1)
            live = cost[rows, best] < _NEVER
            rows, a = rows[live], best[live]
            b = after[rows, a]
            c = after[rows, b]
            sym[rows, a] = piece[rows, a]
            sym[rows, b] = -1
            cost[rows, b] = _NEVER
            after[rows, a] = c
            inner = c < width - 1
            before[rows[inner], c[inner]] = a[inner]
            cost[rows, a], piece[rows, a] = self._pairs(sym[rows, a], sym[rows, c])
            p = before[rows, a]
            r, p, q = rows[p >= 0], p[p >= 0], a[p >= 0]
            cost[r, p], piece[r, p] = self._pairs(sym[r, p], sym[r, q])
        left = sym != -1
        ids = [self.written[i] if i >= 0 else self._spelled(chr(-2 - i)) for i in sym[left].tolist()]
        ends = np.cumsum(left.sum(axis=1)).tolist()
        return ["".join(ids[s:e]) for s, e in zip([0, *ends[:-1]], ends)]

    def merge(self, segment: str) -> str:
        """Decimal ids of a segment, by the agenda on a heap."""
        score, sym = self.score, list(segment)
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := score.get(sym[a] + sym[b])):
                heapq.heappush(agenda, (found[0], a, b, len(sym[a]) + len(sym[b])))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or len(sym[a]) + len(sym[b]) != size:
                continue  # one of the two has been merged meanwhile
            sym[a] += sym[b]
            sym[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            propose(before[a], a)
            propose(a, after[a])
        return "".join(self.written[score[s][1]] if s in score else self._spelled(s) for s in sym if s)

    def _spelled(self, char: str) -> str:
        """Decimal ids of a character that is no piece."""
        ids = [self.bytes[b] for b in char.encode("utf-8")] if self.has_bytes else [self.unknown]
        return "".join(self.written[i] for i in ids)

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, each followed by a comma."""
        split = [self.segments.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) >= KNOWN_SEGMENTS:
            self.known.clear()
        known = self.known
        fresh = list({s for part in split for s in part if s not in known})
        for low, high in ((0, 8), (8, 16), (16, SIDE_BY_SIDE)):
            if some := [s for s in fresh if low < len(s) <= high]:
                known.update(zip(some, self.merge_rows(some)))
        for s in fresh:
            if s not in known:
                known[s] = self.merge(s)
        return ["".join([known[s] for s in part]) for part in split]


@lru_cache(maxsize=1)
def agenda(path: str) -> PieceAgenda:
    return PieceAgenda(path)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array), decoded, ids_text (decimal, commas), agrees; null text is empty and has no ids.

    For models with the identity normaliser, a dummy prefix and escaped blanks that are not collapsed.
    """
    return _encoded(docs, model, False)


def _encoded(docs: DataFrame, model: str | None, digest: bool) -> DataFrame:
    path = model or tokenizer_path("piece_bpe_32k.model")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"] if digest else ["doc_id", "ids", "decoded", "ids_text", "agrees"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, types)))
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def some(encoder: PieceAgenda, doc_ids: list, texts: list) -> pa.RecordBatch:
        said = [s[:-1] for s in encoder.encode(texts)]
        exact = encoder.library.encode(texts, num_threads=1)
        rows = []
        ours = [list(map(int, s.split(","))) if s else [] for s in said]
        decoded = encoder.library.decode(exact, num_threads=1)
        for doc_id, s, a, b, text in zip(doc_ids, said, ours, exact, decoded):
            agrees = a == b
            s = s if agrees else ",".join(map(str, b))
            rows.append((doc_id, len(b), sha(s), sha(text), agrees) if digest else (doc_id, b, text, s, agrees))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = agenda(path)
        for batch in batches:
            doc_ids, texts, chars = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    yield some(encoder, doc_ids, texts)
                    doc_ids, texts, chars = [], [], 0
            if texts:
                yield some(encoder, doc_ids, texts)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" if digest else \
        "doc_id long, ids array<int>, decoded string, ids_text string, agrees boolean"
    return id_and_text(docs).mapInArrow(run, ddl)


@query()
def op7_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(read(spark, sf_dir, "documents"), None, True)
