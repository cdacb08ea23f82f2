"""Causal self-attention language model on subword ids, trained and applied in numpy.

Words (A-Z lower-cased) are spelled in ids of a public byte-level BPE, each with the blank before it, so
the ids determine the words. The most frequent ids are classes of their own, the others share bands of
similar frequency: ``P(id | context) = P(class | context) * P(id | class)``. Classes lie in groups, and a
class has the probability of its group times its own within the group: two small softmaxes, each over the
class bigram of the corpus plus the output of a one-layer causal self-attention network. The bigram counts
every pair of neighbouring ids of the whole training texts. A word has the product of its ids'
probabilities, smoothed with its share of the training words (words that were never seen have no share):
``P(word) = m * P(ids) + (1 - m) * share``. ``m`` is the weight of ``WEIGHTS`` that makes all training texts
together most probable when each word's own occurrence is left out of its share.

Training: one pass over the whole text of every training document. A hash deals the documents to
``ROUNDS`` rounds; in each every task takes Adam steps from the common weights over all windows of its
documents, and the weights are averaged by the amount of text.

Scoring: overlapping windows of ``WINDOW`` ids, ``CONTEXT`` of them repeated from the window before,
score every token once with one batched masked attention. Every id has a query of its own over all ids up to
itself; each id and the one before also enter the hidden units of the next directly.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, read, written
from .registry import query
from .tokens import CACHE_WORDS, byte_bpe, tokenizer_path

WINDOW, CONTEXT = 56, 8
FRESH = WINDOW - CONTEXT
GROUPS, MEMBERS = 16, 32
CLASSES, BANDS = GROUPS * MEMBERS, 16
INPUTS = 512
WIDTH, HIDDEN = 16, 32
ROUNDS = 3
BATCH = 192
TOGETHER = 192
RATE = 1e-2
WEIGHTS = (0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95)  # of the ids, next to the word share
AT_ONCE = 16  # factors multiplied before a logarithm is taken
NO_SHARE = 0.5  # ... when nothing was trained
COMMON_WORDS = 100_000  # bound of the word table that tasks carry; rarer words are joined
LONGEST_COMMON = 64
LOG10 = math.log10(math.e)
LARGEST = 60  # exponents beyond this are cut
PAD, END, IDS = 65_535, 50_256, 50_257
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def out_of_training(doc_id: int | None) -> bool:
    """``held_out`` of one id."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Speller:
    """Subword ids of lower-cased words, as little-endian 16-bit bytes, cached within a bound."""

    def __init__(self):
        self.bpe = byte_bpe(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
        self.known: dict[bytes, bytes] = {}

    def _spell(self, w: bytes) -> bytes:
        text = " " + w.decode("utf-8")
        if len(w) < 64 and w.isascii() and b"<|" not in w:
            out = struct.pack(f"<{len(ids)}H", *ids) if (ids := self.bpe.fast.encode_ordinary(text)) else b""
        else:
            out = self.bpe.encode(text).astype("<u2").tobytes()
        if len(self.known) >= 2 * CACHE_WORDS:
            self.known.clear()
        self.known[w] = out
        return out

    def parts(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        return [known.get(w) or self._spell(w) for w in words]

    def spell(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(words)), "<u2")


_speller: list[Speller] = []


def speller() -> Speller:
    if not _speller:
        _speller.append(Speller())
    return _speller[0]


# --- the model ------------------------------------------------------------------------------------
@dataclass
class Vocabulary:
    """Input index and output class of each id, log10 P(id | class), log class bigram."""

    inputs: np.ndarray
    classes: np.ndarray
    inside: np.ndarray
    bigram: np.ndarray

    @property
    def prior(self) -> Prior:
        if "_prior" not in self.__dict__:
            self.__dict__["_prior"] = two_levels(self.bigram)
        return self.__dict__["_prior"]


def vocabulary(ids: dict[int, int], pairs: dict[tuple[int, int], int]) -> Vocabulary:
    """From counts of ids and of neighbouring (previous id's input, next id's class)."""
    count = np.zeros(IDS, np.float64)
    for i, n in ids.items():
        count[i] = n
    classes, inputs = ranks(count)
    mass = np.bincount(classes, count + 0.5, CLASSES)
    inside = np.full(PAD + 1, 0.0)
    inside[:IDS] = np.log10((count + 0.5) / mass[classes])
    table = np.zeros((INPUTS + 1, CLASSES))
    for (a, b), n in pairs.items():
        table[a, b] += n
    prior = mass / mass.sum()
    bigram = np.log((table + 20 * prior) / (table.sum(axis=1, keepdims=True) + 20))
    wide = np.full(PAD + 1, INPUTS, np.int64)
    wide[:IDS] = inputs
    out = np.zeros(PAD + 1, np.int64)
    out[:IDS] = classes
    return Vocabulary(wide, out, inside, bigram.astype(np.float32))


def ranks(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and inputs by descending count: the first ids alone, the others in bands that double in size."""
    order = np.lexsort((np.arange(IDS), -count))
    place = np.empty(IDS, np.int64)
    place[order] = np.arange(IDS)

    def bands(total: int) -> np.ndarray:
        alone = total - BANDS
        beyond = np.maximum(place - alone, 0) / max(1, IDS - alone)
        band = np.clip(BANDS + np.floor(np.log2(np.maximum(beyond, 1e-9)) * (BANDS / 12)), 0, BANDS - 1).astype(np.int64)
        return np.where(place < alone, place, alone + band)

    return bands(CLASSES), bands(INPUTS)


SHAPES = {"embed": (INPUTS + 1, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "join": (WIDTH, HIDDEN),
          "wide": (WIDTH, HIDDEN), "before": (WIDTH, HIDDEN), "shift": (HIDDEN,), "group": (HIDDEN, GROUPS), "member": (GROUPS, HIDDEN, MEMBERS)}
_CAUSAL = np.where(np.arange(WINDOW) <= np.arange(CONTEXT, WINDOW)[:, None], 0, -1e9).astype(np.float32)


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * (0.5 if k in ("embed", "place") else s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}
    w["shift"][:] = 0.1
    w["group"][:], w["member"][:] = 0, 0  # starts as the bigram
    return w


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = np.asarray(x[at:at + n], np.float32).reshape(s)
        at += n
    return out


@dataclass
class Prior:
    """The class bigram in two levels: log P(group | input), log P(class | group, input)."""

    group: np.ndarray
    member: np.ndarray


def two_levels(bigram: np.ndarray) -> Prior:
    parts = bigram.reshape(len(bigram), GROUPS, MEMBERS)
    top = parts.max(axis=2, keepdims=True)
    group = top + np.log(np.exp(parts - top).sum(axis=2, keepdims=True))
    return Prior(np.ascontiguousarray(group[:, :, 0]), np.ascontiguousarray(parts - group))


def attended(w: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, dict]:
    """Hidden units (windows, FRESH, HIDDEN) for windows of inputs, and what the backward pass needs.

    A unit sums its id, the id before and what its own query found among all ids up to it.
    """
    e = w["embed"].take(inputs, axis=0)
    parts = np.empty((len(e), FRESH, 3 * WIDTH), e.dtype)  # the id before, the id, what was attended
    parts[:, :, :WIDTH], parts[:, :, WIDTH:2 * WIDTH] = e[:, CONTEXT - 1:-1], e[:, CONTEXT:]
    x = e
    x += w["place"]
    qkv = (x.reshape(-1, WIDTH) @ looked_up(w)).reshape(len(x), WINDOW, 3 * WIDTH)
    q, k, v = qkv[:, CONTEXT:, :WIDTH], qkv[:, :, WIDTH:2 * WIDTH], qkv[:, :, 2 * WIDTH:]
    s = np.matmul(q, k.transpose(0, 2, 1))
    s += _CAUSAL
    padded = np.flatnonzero(inputs[:, 0] == INPUTS)  # padding is not attended to; what follows the last target cannot be
    s[padded] += np.where(inputs[padded] == INPUTS, np.float32(-1e9), np.float32(0))[:, None, :]
    s = softmax(s)
    np.matmul(s, v, out=parts[:, :, 2 * WIDTH:])
    g = parts.reshape(-1, 3 * WIDTH) @ joined(w)
    g += w["shift"]
    return np.maximum(g, 0, out=g).reshape(len(x), FRESH, HIDDEN), {"parts": parts, "x": x, "q": q, "k": k, "v": v, "s": s}


def looked_up(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w["query"] * w["query"].dtype.type(WIDTH ** -0.5), w["key"], w["value"]], axis=1)


def joined(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w["before"], w["wide"], w["join"]])


def softmax(p: np.ndarray) -> np.ndarray:
    """In place, along the last axis."""
    if p.max() > LARGEST:
        p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[-1], p.dtype)
    p *= (1 / np.maximum(total, 1e-30))[..., None]
    return p


def forward(w: dict[str, np.ndarray], prior: Prior, inputs: np.ndarray) -> np.ndarray:
    """Probabilities of all classes (windows, FRESH, CLASSES): the definition, which scoring and training shorten."""
    g, _ = attended(w, inputs)
    last = inputs[:, CONTEXT:]
    group = softmax(g @ w["group"] + prior.group[last])
    member = softmax(np.einsum("nth,ghm->ntgm", g, w["member"]) + prior.member[last])
    return (group[..., None] * member).reshape(*last.shape, CLASSES)


@dataclass
class Chosen:
    """The wanted positions ordered by the group of their target: their units, last inputs, targets in two levels, logits."""

    order: np.ndarray
    units: np.ndarray
    last: np.ndarray
    group: np.ndarray
    member: np.ndarray
    slices: list[tuple[int, slice]]
    groups: np.ndarray
    members: np.ndarray


def chosen_targets(w: dict[str, np.ndarray], prior: Prior, g: np.ndarray, inputs: np.ndarray, targets: np.ndarray, there: np.ndarray) -> Chosen:
    at = np.flatnonzero(there)
    target = targets.ravel()[at]
    turn = np.argsort((target // MEMBERS).astype(np.int16), kind="stable")
    order, target = at[turn], target[turn]
    group = target // MEMBERS
    ends = np.searchsorted(group, np.arange(GROUPS), side="right").tolist()
    slices = [(n, slice(i, j)) for n, (i, j) in enumerate(zip([0, *ends[:-1]], ends)) if j > i]
    units, last = g.reshape(-1, HIDDEN).take(order, axis=0), inputs[:, CONTEXT:].ravel()[order]
    groups = units @ w["group"]
    groups += prior.group.take(last, axis=0)
    members = prior.member.reshape(-1, MEMBERS).take(last * GROUPS + group, axis=0)
    for n, rows in slices:
        members[rows] += units[rows] @ w["member"][n]
    return Chosen(order, units, last, group, target - group * MEMBERS, slices, groups, members)


def log_chosen(w: dict[str, np.ndarray], prior: Prior, inputs: np.ndarray, targets: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the target classes' probabilities; as ``forward``, with each softmax reduced to its sum.

    Padding can only be the first CONTEXT inputs of a window (and what follows the last target); only targets
    that are ``there`` are worked out, others are 0.
    """
    g, _ = attended(w, inputs)
    c = chosen_targets(w, prior, g, inputs, targets, np.ones(targets.shape, bool) if there is None else there)
    out = np.zeros(targets.shape, g.dtype)
    out.reshape(-1)[c.order] = log_picked(c.groups, c.group) + log_picked(c.members, c.member)
    return out


def log_picked(p: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log softmax at one column of each row."""
    if p.size and (p.max() > LARGEST or p.min() < -LARGEST):
        p -= p.max(axis=1, keepdims=True)
    picked = p[np.arange(len(p)), column]
    return picked - np.log(np.exp(p, out=p) @ np.ones(p.shape[1], p.dtype))


def sums_by(place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows for each input."""
    order = np.argsort(place.astype(np.int16), kind="stable")
    there, first = np.unique(place[order], return_index=True)
    out = np.zeros((INPUTS + 1, rows.shape[1]), rows.dtype)
    out[there] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out


def gradient(w: dict[str, np.ndarray], prior: Prior, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross entropy of the target classes."""
    g, c = attended(w, inputs)
    t = chosen_targets(w, prior, g, inputs, targets, weight > 0)
    share = (weight.ravel()[t.order] / max(1.0, weight.sum())).astype(g.dtype)[:, None]
    every = np.arange(len(t.order))
    rows = lambda z: z.reshape(-1, z.shape[-1])
    d = softmax(t.groups)
    d[every, t.group] -= 1
    d *= share
    out = {"group": t.units.T @ d, "member": np.zeros_like(w["member"])}
    du = d @ w["group"].T
    d = softmax(t.members)
    d[every, t.member] -= 1
    d *= share
    for n, at in t.slices:
        out["member"][n] = t.units[at].T @ d[at]
        du[at] += d[at] @ w["member"][n].T
    du *= t.units > 0
    out["shift"] = np.ones(len(du), du.dtype) @ du
    dg = np.zeros((g.size // HIDDEN, HIDDEN), g.dtype)
    dg[t.order] = du
    both = rows(c["parts"]).T @ dg
    out["before"], out["wide"], out["join"] = both[:WIDTH], both[WIDTH:2 * WIDTH], both[2 * WIDTH:]
    dparts = (dg @ joined(w).T).reshape(c["parts"].shape)
    da = dparts[:, :, 2 * WIDTH:]
    ds = np.matmul(da, c["v"].transpose(0, 2, 1))
    ds -= (da * c["parts"][:, :, 2 * WIDTH:]).sum(axis=2, keepdims=True)
    ds *= c["s"]
    dqkv = np.zeros((*inputs.shape, 3 * WIDTH), ds.dtype)
    np.matmul(ds, c["k"], out=dqkv[:, CONTEXT:, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), c["q"], out=dqkv[:, :, WIDTH:2 * WIDTH])
    np.matmul(c["s"].transpose(0, 2, 1), da, out=dqkv[:, :, 2 * WIDTH:])
    all_three = rows(c["x"]).T @ rows(dqkv)
    out["query"] = all_three[:, :WIDTH] * ds.dtype.type(WIDTH ** -0.5)
    out["key"], out["value"] = all_three[:, WIDTH:2 * WIDTH], all_three[:, 2 * WIDTH:]
    dx = (rows(dqkv) @ looked_up(w).T).reshape(*inputs.shape, WIDTH)
    out["place"] = dx.sum(axis=0)
    dx[:, CONTEXT:] += dparts[:, :, WIDTH:2 * WIDTH]
    dx[:, CONTEXT - 1:-1] += dparts[:, :, :WIDTH]
    out["embed"] = sums_by(inputs.ravel(), rows(dx))
    return out


class Adam:
    def __init__(self, rate: float = RATE):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k in w:
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g[k]
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g[k] ** 2
            w[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.n)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.n)) + 1e-6)


def windows(ids: np.ndarray, start: bool = True) -> np.ndarray:
    """(n, WINDOW + 1): overlapping windows; column CONTEXT + 1 onward are targets, each id once, PAD beyond the end."""
    lead = np.full(CONTEXT + 1, PAD, np.int64)
    if start:
        lead[-1] = END
    n = -(-len(ids) // FRESH)
    z = np.full(n * FRESH + CONTEXT + 1, PAD, np.int64)
    z[:CONTEXT + 1] = lead
    z[CONTEXT + 1:CONTEXT + 1 + len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(z, WINDOW + 1)[::FRESH]


# --- what is gathered from the corpus ---------------------------------------------------------------
def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the training documents (the end mark is not among them)."""
    def counted(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(text.as_py().encode("utf-8").translate(_LOWER).split())
                if len(counts) >= CACHE_WORDS:
                    yield counted(counts)
        yield counted(counts)

    texts = id_and_text(docs).filter(~held_out(F.col("doc_id"))).select("text")
    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gather_vocabulary(docs: DataFrame, counts: DataFrame, n_docs: int) -> Vocabulary:
    """Ids of all training words, and class bigrams over all neighbouring ids of the training texts; the
    first id follows the end mark.

    What is collected has at most one row per id, then one per input and class.
    """
    def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            parts = speller().parts([w.encode("utf-8") for w in batch.column(0).to_pylist()])
            c = np.repeat(batch.column(1).to_numpy(), [len(x) // 2 for x in parts])
            total += np.bincount(np.frombuffer(b"".join(parts), "<u2"), c, IDS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    ids = {r["id"]: r["n"] for r in counts.select("word", "c").mapInArrow(id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    ids[END] = ids.get(END, 0) + n_docs
    count = np.zeros(IDS)
    for i, n in ids.items():
        count[i] = n
    classes, inputs = ranks(count)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(INPUTS * CLASSES, np.int64), [np.empty(0, np.int64)], 0
        for batch in batches:
            for text in batch.column(0):
                z = speller().spell(text.as_py().encode("utf-8").translate(_LOWER).split())
                z = np.concatenate([[END], z, [END]])
                held.append(inputs[z[:-1]] * CLASSES + classes[z[1:]])
                n += len(z)
                if n >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, n = [np.empty(0, np.int64)], 0
        total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    texts = id_and_text(docs).filter(~held_out(F.col("doc_id"))).select("text")
    cells = texts.mapInArrow(pair_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return vocabulary(ids, {divmod(r["cell"], CLASSES): r["n"] for r in cells})


def document_windows(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The windows of each text's ids and its end token."""
    for text in texts:
        ids = speller().spell(text.encode("utf-8").translate(_LOWER).split()).astype(np.int64)
        yield windows(np.append(ids, END))


def batches_of(arrays: Iterable[np.ndarray], size: int = BATCH) -> Iterator[np.ndarray]:
    """The rows of all arrays, ``size`` at a time and the rest at the end."""
    held, n = [], 0
    for z in arrays:
        held.append(z)
        n += len(z)
        if n >= size:
            z = np.concatenate(held)
            yield from (z[i:i + size] for i in range(0, n - n % size, size))
            held, n = [z[n - n % size:]], n % size
    if n:
        yield np.concatenate(held)


def training_documents(docs: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """The texts of round ``k``; every training document is in one round."""
    d = id_and_text(docs).filter(~held_out(F.col("doc_id")))
    return d.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k).select("text")


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """One pass over all training documents in rounds of local Adam steps and averaging; what is collected
    has the size of the model."""
    w = initial()

    def local(start: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, adam, n = unflat(start.copy()), Adam(), 0
            texts = (text.as_py() for batch in batches for text in batch.column(0))
            for part in batches_of(document_windows(texts)):
                targets = part[:, CONTEXT + 1:]
                adam.step(mine, gradient(mine, vocab.prior, vocab.inputs[part[:, :-1]], vocab.classes[targets], (targets != PAD).astype(np.float32)))
                n += len(part)
            if n:
                x = flat(mine).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x * n), pa.array(np.full(len(x), n))], names=["i", "x", "n"])
        return run

    for k in range(rounds):
        part = training_documents(docs, k, rounds)
        mean = part.mapInArrow(local(flat(w)), "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).collect()
        if not mean:
            continue
        x = np.empty(len(mean))
        for r in mean:
            x[r["i"]] = r["x"]
        w = unflat(x)
    return w


def target_scores(w: dict[str, np.ndarray], vocab: Vocabulary, z: np.ndarray) -> np.ndarray:
    """log10 probability of every target of the windows, in their order without padding; few windows at a
    time, so that the work stays in the processor's cache."""
    out = []
    for i in range(0, len(z), TOGETHER):
        part = z[i:i + TOGETHER]
        targets = part[:, CONTEXT + 1:]
        there = targets != PAD
        chosen = log_chosen(w, vocab.prior, vocab.inputs[part[:, :-1]], vocab.classes[targets], there)
        out.append(chosen[there] * LOG10 + vocab.inside[targets[there]])
    return np.concatenate(out)


def mixtures(by_ids: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sum over words of log10(m * P(ids) + (1 - m) * share) for each weight m, from log10 values."""
    return mixtures_each(by_ids, share, np.zeros(len(share), np.int64), 1)[0]


def mixtures_each(by_ids: np.ndarray, share: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """``mixtures`` of ``n`` texts, given the number of each word's text, in rising order: a row per text.

    Without a share (-inf) a word has m * P(ids) alone. Ratios to the share are multiplied ``AT_ONCE`` at a time:
    they lie between 1 - m and 10^13, so no product leaves the range of doubles.
    """
    none = np.isneginf(share)
    some, alone = text[~none], np.bincount(text[none], minlength=n)
    base = np.bincount(text[none], by_ids[none], n) + np.bincount(some, share[~none], n)
    count = np.bincount(some, minlength=n)
    blocks = -(-count // AT_ONCE)
    shift = (np.cumsum(blocks) - blocks) * AT_ONCE - (np.cumsum(count) - count)  # each text begins a block
    ratio = np.ones(int(blocks.sum()) * AT_ONCE)
    ratio[np.arange(len(some)) + shift[some]] = np.exp(np.minimum(by_ids[~none] - share[~none], 13) / LOG10)
    block_text = np.repeat(np.arange(n), blocks)
    out = np.empty((n, len(WEIGHTS)))
    for j, m in enumerate(WEIGHTS):
        product = m * ratio
        product += 1 - m  # a padded factor is m + 1 - m = 1
        while len(product) > len(block_text):
            product = product[::2] * product[1::2]
        out[:, j] = base + alone * math.log10(m) + np.bincount(block_text, np.log10(product), n)
    return out


def fitted_weight(rows: DataFrame, rare: DataFrame, mixed: Callable[[float], Column]) -> int:
    """Index of the weight under which all training texts are most probable, each word's own occurrence left out
    of its share; words outside the table are in ``rare``."""
    training = rows.filter(~held_out(F.col("doc_id")))
    common = training.agg(*(F.sum(F.col("fit_scores")[k]) for k in range(len(WEIGHTS)))).first()
    others = rare.join(training.select("row"), "row", "left_semi").agg(*(F.sum(mixed(m)) for m in WEIGHTS)).first()
    return int(np.argmax([a + (b or 0) for a, b in zip(common, others)]))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Null text is empty and has the end token alone; a null doc_id counts as an empty text for the fold.
    Without training documents the counts are zero and the model is uniform over its classes.
    """
    counts = written(word_counts(docs), "word-counts")
    n_docs = docs.filter(~held_out(F.col("doc_id").cast("long"))).count()
    n_words, v_words = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (n_words or 0) + n_docs, v_words + (n_docs > 0)
    vocab = gather_vocabulary(docs, counts, n_docs)
    model = train(docs, vocab)
    scale = math.log10(total + 0.5 * (distinct + 1))
    others = math.log10(max(total - 1, 0) + 0.5 * (distinct + 1))  # without the word's own occurrence

    def left_out(c: int) -> float:
        return math.log10(c - 0.5) - others if c > 1 else -math.inf

    common = [(r["word"].encode("utf-8"), math.log10(r["c"] + 0.5) - scale, left_out(r["c"])) for r in
              counts.filter(F.octet_length("word") <= LONGEST_COMMON).orderBy(F.desc("c"), "word").limit(COMMON_WORDS).collect()]
    end_score = math.log10(n_docs + 0.5) - scale
    numbers, end_number = {w: i for i, (w, _, _) in enumerate(common)}, len(common)
    logs = np.array([x[1:] for x in common] + [(end_score, left_out(n_docs)) if n_docs else (-math.inf, -math.inf)])
    shared = docs.sparkSession.sparkContext.broadcast((numbers, logs, model, vocab))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.float64())]
    schema = pa.schema(list(zip(["doc_id", "n_tokens", "known", "common_base", "common_scores", "fit_scores", "rare", "rare_ids"], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (shares, left), w, voc = shared.value[0], shared.value[1].T, *shared.value[2:]
        end = np.array([END], np.int64)

        def flush(held: list[tuple]) -> pa.RecordBatch:
            """Scores of some documents (doc_id, words, ids, ids of each word) in common batches."""
            n = len(held)
            scores = target_scores(w, voc, np.concatenate([windows(ids) for _, _, ids, _ in held]))
            sizes = np.concatenate([x for _, _, _, x in held])
            mine = np.add.reduceat(scores, np.cumsum(sizes) - sizes)  # one per word, and the ends
            n_tokens = np.array([len(words) + 1 for _, words, _, _ in held])
            text = np.repeat(np.arange(n), n_tokens)
            number = np.fromiter((i for _, words, _, _ in held for i in [*map(table.get, words, repeat(-1)), end_number]), np.int64, len(text))
            seen = number >= 0
            mixed = mixtures_each(mine[seen], shares[number[seen]], text[seen], n)
            trained = np.array([not out_of_training(doc_id) for doc_id, _, _, _ in held])
            own = seen & trained[text]
            fit = np.where(trained[:, None], mixtures_each(mine[own], left[number[own]], text[own], n), mixed)
            listed = seen & (number != end_number)
            base = np.bincount(text[listed], shares[number[listed]], n) + end_score
            every = [x for _, words, _, _ in held for x in [*words, b""]]
            rare = np.flatnonzero(~seen)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=n))]), pa.int32())
            fixed = pa.array(np.arange(n + 1) * len(WEIGHTS), pa.int32())
            columns = [pa.array([x[0] for x in held], pa.int64()), pa.array(n_tokens), pa.array(np.bincount(text[seen], minlength=n) - (n_docs == 0)), pa.array(base),
                       pa.ListArray.from_arrays(fixed, pa.array(mixed.ravel())), pa.ListArray.from_arrays(fixed, pa.array(fit.ravel())),
                       pa.ListArray.from_arrays(ends, pa.array([every[i].decode("utf-8") for i in rare], pa.string())), pa.ListArray.from_arrays(ends, pa.array(mine[rare].astype(np.float64)))]
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], schema=schema)

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().encode("utf-8").translate(_LOWER).split()
                parts = speller().parts(words)
                ids = np.append(np.frombuffer(b"".join(parts), "<u2").astype(np.int64), end)
                held.append((doc_id, words, ids, np.append(np.fromiter(map(len, parts), np.int64, len(parts)) // 2, 1)))
                size += len(ids)
                if size >= 200_000:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, known long, common_base double, common_scores array<double>, fit_scores array<double>, "
                                               "rare array<string>, rare_ids array<double>")
    rows = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "rare_ids")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_ids").alias("ids"))
    share = (F.col("c") + 0.5) / 10.0 ** scale
    joined = pairs.join(counts, "word", "left")

    def mixed(m: float) -> Column:
        return F.when(F.col("c").isNull(), F.col("ids") + math.log10(m)).otherwise(F.log10(m * F.pow(F.lit(10.0), "ids") + (1 - m) * share))

    def fit(m: float) -> Column:
        left = (F.col("c") - 0.5) / 10.0 ** others
        return F.when(F.col("c").isNull() | (F.col("c") < 2), F.col("ids") + math.log10(m)).otherwise(F.log10(m * F.pow(F.lit(10.0), "ids") + (1 - m) * left))

    at = fitted_weight(rows, joined, fit) if n_docs else WEIGHTS.index(NO_SHARE)
    rare = (joined.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) - scale).alias("rare_base"), F.count("c").alias("rare_known"),
                                      F.sum(mixed(WEIGHTS[at])).alias("rare_score")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (rows.drop("rare", "rare_ids").join(rare, "row", "left")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"), (F.col("common_base") + zero("rare_base")).alias("base_score"),
                    (F.col("common_scores")[at] + zero("rare_score")).alias("score")))


@query()
def op6_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
