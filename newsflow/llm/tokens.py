"""Public tokenizers inside tasks: loaded once per worker, words cached within a bound.

``ByteBpe`` and ``WordBpe`` give the ids of the ``tokenizers`` library. Texts of ordinary characters
take a faster road with the same result (``tiktoken`` over the same ranks; the library's model behind a
word cache); any other text, or one that spells a special token, goes to the library itself.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHE_WORDS = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# letters, digits, marks and blanks on which both libraries' character classes agree
_ORDINARY = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
_LONG_RUN = re.compile(r"\S{1000}")


class ByteBpe:
    """Byte-level BPE; ``encode`` returns unsigned 32-bit ids."""

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and "<|" not in text and not _ORDINARY.search(text) and not _LONG_RUN.search(text):
            return np.asarray(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class WordBpe:
    """BPE over lower-cased words with an end-of-word mark; ``encode`` returns little-endian 16-bit ids."""

    _ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        self.model = self.exact.model
        self.letters = _byte_letters()
        self.wide = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.known: dict[str, bytes] = {}

    def _word(self, w: str) -> bytes:
        spelled = w if w.isascii() else "".join(self.letters[b] for b in w.encode("utf-8"))
        out = np.asarray([t.id for t in self.model.tokenize(spelled)], dtype="<u2").tobytes()
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[w] = out
        return out

    def encode(self, text: str) -> bytes:
        if "<|" in text or _ORDINARY.search(text):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        text = text.lower()
        known, words = self.known, (self._ASCII if text.isascii() else self.wide).findall(text)
        return b"".join([known.get(w) or self._word(w) for w in words])


@lru_cache(maxsize=2)
def byte_bpe(path: str, ranks_path: str | None) -> ByteBpe:
    return ByteBpe(path, ranks_path)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
