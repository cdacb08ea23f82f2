"""Secrets by patterns and by dictionary-primed zstandard novelty.

Patterns give the base spans. Beyond them, a run of at least 16 credential characters is a candidate if a
sensitive word stands shortly before it. A candidate is measured by what it adds to the compressed size of
the code around it: the text before and after it and the parts of identifiers that are frequent in and around
candidates of the whole corpus prime the compressor, so names, paths, placeholders and repeated words cost a few bytes,
while a random string costs nearly its own entropy. Candidates that cost at least ``LEAST_NOVELTY`` bytes
per character are reported.

Two passes: the first finds spans and candidates with their surroundings (one row per document), the
identifier counts of all surroundings are summed by Spark, and the second measures. Texts are read once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, read, written
from .registry import query

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),  # runs are maximal, so this equals dropping the shorter ones
}
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST_VALUE, LEAST_ACCESS = 8, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api.?key|private.?key|credential|bearer|authoriz|signature|client.?id|access.?key|aws_|ghp_|sk_live|xox[abp]-",
                       re.IGNORECASE | re.ASCII)
PARTS = r"[A-Za-z][a-z]{3,}|[A-Z]{4,}"  # of identifiers; random strings have next to none, however often they are copied
BEFORE = 48  # characters in which the sensitive word must end
LONGEST_WORD = 16
AROUND = 240  # characters of code on each side
LONGEST_MEASURED = 4_096  # of longer candidates each stretch of this size is measured
LEAST_NOVELTY = 0.7
LEVEL = 9
DICTIONARY_WORDS = 4_000  # most frequent identifiers around candidates; bounds what every task carries


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base matches, ordered by start, then kind as listed."""
    low = text.lower()
    found = []
    if any(word in low for word in NAMES):  # far cheaper than the pattern
        found += [(m.start(), m.end(), "assign") for m in PATTERNS["assign"].finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in PATTERNS["hex"].finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    place = {k: i for i, k in enumerate((*KINDS, "novel"))}
    return sorted(spans, key=lambda s: (s[0], place[s[2]], s[1]))


def mixed(run: str) -> bool:
    """Digits and letters both: an unbroken word of any length is prose."""
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, str]]:
    """start, end, the run, the code before and after it: mixed runs near a sensitive word that no base span touches."""
    taken, out = joined(base), []
    b = 0  # taken spans from b on end after the run's start
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while b < len(taken) and taken[b][1] <= start:
            b += 1
        if b < len(taken) and taken[b][0] < end or not mixed(m.group()):
            continue
        left = max(0, start - BEFORE - LONGEST_WORD)
        last = max((w.end() for w in SENSITIVE.finditer(text, left, end)), default=-BEFORE - 1)  # a prefix such as ghp_ is part of the run
        if last > start or last >= start - BEFORE and "\n\n" not in text[last:start]:
            out.append((start, end, m.group(), text[max(0, start - AROUND):start], text[end:end + AROUND]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> list[list[int]]:
    """Spans ordered by start as disjoint stretches."""
    out: list[list[int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


class Novelty:
    """Compressed bytes that a string adds to the code around it."""

    def __init__(self, words: list[str]):
        import zstandard
        self.z = zstandard
        self.shared = "\n".join(words).encode()  # most frequent last: nearest to the end is cheapest to refer to

    def of(self, run: str, before: str, after: str) -> float:
        """Marginal compressed bytes per character, of the most novel stretch of a long run."""
        code = (after + "\n" + before).encode()
        level = self.z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        primed = self.z.ZstdCompressionDict(self.shared + b"\n" + code, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        press = self.z.ZstdCompressor(dict_data=primed, compression_params=level)
        empty = len(press.compress(before[-8:].encode()))
        return max((len(press.compress((before[-8:] + run[k:k + LONGEST_MEASURED]).encode())) - empty) / len(run[k:k + LONGEST_MEASURED])
                   for k in range(0, len(run), LONGEST_MEASURED))


_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("run", pa.string()), ("before", pa.string()), ("after", pa.string())])


def found_spans(docs: DataFrame) -> DataFrame:
    """Per document its base spans, their digest, and its candidates with the code around them."""
    def find(batches):
        for batch in batches:
            counts, spans, cands = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                kinds = Counter(k for _, _, k in base)
                counts.append([kinds[k] for k in KINDS])
                spans.append([f"{k}:{s}:{e}" for s, e, k in base])
                cands.append([dict(zip(("start", "end", "run", "before", "after"), c)) for c in candidates(text, base)])
            columns = list(zip(*counts)) if counts else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(spans, pa.list_(pa.string())), pa.array(cands, pa.list_(_FOUND))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "candidates"])

    return id_and_text(docs).mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base array<string>, "
                                              "candidates array<struct<start: long, end: long, run: string, before: string, after: string>>")


def frequent_identifiers(found: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The ``words`` parts of identifiers that stand in or around most candidates, rarest first; counted over all of them."""
    c = found.select(F.explode("candidates").alias("c")).select(F.concat_ws("\n", "c.before", "c.run", "c.after").alias("code"))
    names = c.select(F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(PARTS), 0))).alias("word"))
    top = (names.filter(F.length("word") <= 64).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
           .orderBy(F.desc("n"), "word").limit(words))
    return [r["word"] for r in top.collect()][::-1]


def scan_secrets(docs: DataFrame, words: int = DICTIONARY_WORDS, least: float = LEAST_NOVELTY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel: one row per row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive; base spans always stay, kind ``novel`` is what
    the method adds. Null and empty texts have no spans. Rows that repeat a doc_id are judged one by one. An
    empty table gives no rows. Other columns are ignored.
    """
    found = written(found_spans(docs), "secret-candidates")
    shared = frequent_identifiers(found, words)

    def judge(batches):
        novelty = Novelty(shared)
        for batch in batches:
            digest, spans, n_novel = [], [], []
            for base, cands in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist()):
                digest.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                new = [(c["start"], c["end"], "novel") for c in cands
                       if novelty.of(c["run"], c["before"], c["after"]) >= least]
                n_novel.append(len(new))
                if new:
                    parts = (s.split(":") for s in base)
                    base = [f"{k}:{s}:{e}" for s, e, k in in_order([(int(s), int(e), k) for k, s, e in parts] + new)]
                spans.append(",".join(base))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")), pa.array(digest, pa.string()),
                 pa.array(spans, pa.string()), pa.array(n_novel, pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return found.mapInArrow(judge, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


@query()
def op12_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents")).drop("n_novel")
