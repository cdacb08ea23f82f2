"""Many word lists found in a text by one scan.

All words of all lists form one prefix tree, written as a regular expression that is tried at every
character inside a look-ahead, so overlapping words are all met; at a character it captures the longest
word that starts there. Other listed words that start at the same character are prefixes of it, so each
captured word stands for itself and the words it begins with. The scan gives one small integer per
(list, place in the list) that the text contains, in the order of lists and places; "contains one of",
"how many", "first listed" and "highest weight" are then questions to that short array.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

ROOM = 4096  # places per list
ENTRY = "array<array<struct<w:string,c:array<int>>>>"


def _chosen(branches: dict[str, str]) -> str:
    """A regular expression that decides by the first character in few steps: halves of the sorted characters."""
    heads = sorted(branches)
    if len(heads) <= 12:
        return "|".join(re.escape(h) + branches[h] for h in heads)
    half = len(heads) // 2
    left, right = ({h: branches[h] for h in part} for part in (heads[:half], heads[half:]))
    return f"(?=[\\x{{{ord(heads[0]):x}}}-\\x{{{ord(heads[half - 1]):x}}}])(?:{_chosen(left)})|(?:{_chosen(right)})"


def tree(words: Iterable[str]) -> str:
    """Expression for the longest of the words that starts at a place."""
    return _tree(sorted({w for w in words if w}))


def _tree(words: list[str]) -> str:
    """Expression for the longest of the words (without duplicates) at a place; "" among them makes it optional."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    branches = {}
    for head, rest in tails.items():
        shared = 0  # characters that all words of the branch share
        while all(len(t) > shared for t in rest) and len({t[shared] for t in rest}) == 1:
            shared += 1
        branches[head] = re.escape(rest[0][:shared]) + _tree([t[shared:] for t in rest])
    if not branches:
        return ""
    return f"(?:{_chosen(branches)})" + ("?" if "" in words else "")


class Lexicon:
    """Word lists under names; words count as they are written, so give lower-case words for lower-case text."""

    def __init__(self, lists: dict[str, Iterable[str]]):
        self.lists = {name: list(words) for name, words in lists.items()}
        self.number = {name: i for i, name in enumerate(self.lists)}
        if any(len(words) > ROOM for words in self.lists.values()):
            raise ValueError(f"a list has more than {ROOM} words")
        places: dict[str, list[int]] = {}
        for name, words in self.lists.items():
            for place, word in enumerate(words):
                if word:
                    places.setdefault(word, []).append(self.number[name] * ROOM + place)
        self.pattern = f"(?s)(?=((?>{tree(places)})))"
        self.size = 1 << max(len(places).bit_length(), 1)
        table: list[list] = [[] for _ in range(self.size)]
        for word in places:
            codes = sorted(c for n in range(1, len(word) + 1) for c in places.get(word[:n], ()))
            table[zlib.crc32(word.encode()) % self.size].append({"w": word, "c": codes})
        self.table = json.dumps(table, ensure_ascii=False, separators=(",", ":"))
        self.empty = not places

    def scan(self, text: Column) -> Column:
        """Sorted distinct codes of the contained words; empty for null."""
        nothing = F.array().cast("array<int>")
        if self.empty:
            return nothing
        table = F.from_json(F.lit(self.table), ENTRY)  # folded to one value when the plan is optimized
        words = F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1)))

        def codes(word: Column) -> Column:
            slot = F.get(table, F.pmod(F.crc32(F.encode(word, "UTF-8")), F.lit(self.size)).cast("int"))
            return F.flatten(F.transform(F.filter(slot, lambda e: e["w"] == word), lambda e: e["c"]))

        return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(words, codes)))), nothing)

    def found(self, text: Column) -> Found:
        """Answers about a text expression; the scan is part of each answer, so prefer ``add`` for several."""
        return Found(self, self.scan(text))

    def add(self, df: DataFrame, text: Column, out: str = "_codes") -> tuple[DataFrame, Found]:
        """The table with the scan as a column that is computed once per row, and the answers from it."""
        made = F.inline(F.array(F.struct(self.scan(text).alias(out))))
        return df.select(*[c for c in df.columns if c != out], made), Found(self, F.col(out))


def _kind(values: list) -> str:
    """SQL type of a list of values, or of dicts of values."""
    known = [v for v in values if v is not None]
    if known and isinstance(known[0], dict):
        return "struct<" + ",".join(f"`{k}`:{_kind([v[k] for v in known])}" for k in known[0]) + ">"
    return "double" if any(isinstance(v, float) for v in known) else "int" if any(isinstance(v, int) for v in known) else "string"


class Found:
    """Questions to the codes of one text."""

    def __init__(self, lexicon: Lexicon, codes: Column):
        self.lexicon, self.codes = lexicon, codes

    def _range(self, name: str) -> tuple[int, int]:
        first = self.lexicon.number[name] * ROOM
        return first, first + len(self.lexicon.lists[name]) - 1

    def places(self, name: str) -> Column:
        """Places in the list of the contained words, rising."""
        low, high = self._range(name)
        return F.transform(F.filter(self.codes, lambda c: c.between(low, high)), lambda c: c - low)

    def any(self, *names: str) -> Column:
        """Whether a word of one of the lists is contained."""
        ranges = [self._range(n) for n in names]

        def inside(c: Column) -> Column:
            tests = [c.between(a, b) for a, b in ranges]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        return F.exists(self.codes, inside)

    def count(self, name: str) -> Column:
        """How many entries of the list are contained."""
        return F.size(self.places(name))

    def pick(self, name: str, values: list) -> Column:
        """The values of the contained words, in listed order; ``values`` has one for each place."""
        table = F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"array<{_kind(values)}>")
        return F.transform(self.places(name), lambda p: F.get(table, p))

    def words(self, name: str, spelled: list[str] | None = None) -> Column:
        return self.pick(name, list(spelled or self.lexicon.lists[name]))

    def max_weight(self, name: str, weights: list[float]) -> Column:
        """Highest weight among the contained words, 0 when there is none."""
        return F.coalesce(F.array_max(self.pick(name, [float(w) for w in weights])), F.lit(0.0))

    def first(self, name: str, values: list) -> Column:
        """Value of the first listed word that is contained; else null."""
        return F.get(self.pick(name, values), F.lit(0))
