"""The language model: counts and base against brute force, probabilities, gradient, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np

from newsflow.llm import attention_lm as A

from . import corpus

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(A, "COMMON_WORDS", 50)  # most words take the join
    data = corpus.rows(3)
    got = A.score_documents(corpus.frame(spark, data)).collect()
    words = [(i, (t or "").encode().translate(LOWER).split() + [None]) for i, t in data]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, ws in words for w in ws if not out(i))
    total = sum(count.values())
    want = sorted(((i, out(i), len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in ws), 6))
                   for i, ws in words), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert A.score_documents(corpus.empty(spark)).count() == 0


def test_without_training_rows(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = A.score_documents(corpus.frame(spark, [(only, "some words")])).first()
    assert r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0


def vocabulary(seed=1):
    rng = np.random.default_rng(seed)
    return A.vocabulary({int(i): int(n) for i, n in zip(rng.integers(0, A.IDS, 3000), rng.zipf(1.5, 3000) % 1000)}, {})


def test_probabilities_sum_to_one():
    v = vocabulary()
    inside = np.bincount(v.classes[:A.IDS], 10 ** v.inside[:A.IDS], A.CLASSES)
    assert np.allclose(inside, 1) and np.allclose(np.exp(v.bigram).sum(axis=1), 1, atol=1e-4)
    w = A.initial()
    for k in ("group", "member"):
        w[k] += 0.1 * np.random.default_rng(2).standard_normal(w[k].shape).astype(np.float32)
    p = A.forward(w, v.prior, np.random.default_rng(3).integers(0, A.INPUTS + 1, (5, A.WINDOW)))
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)


def test_scoring_equals_the_forward_pass():
    v, w, rng = vocabulary(), A.initial(), np.random.default_rng(9)
    w = {k: (x + 0.2 * rng.standard_normal(x.shape)).astype(np.float32) for k, x in w.items()}
    z = np.concatenate([A.windows(rng.integers(0, A.IDS, n)) for n in (3, 48, 200)])
    t = z[:, A.CONTEXT + 1:]
    x = v.inputs[z[:, :-1]]
    p = A.forward(w, v.prior, x)
    want = np.log(np.take_along_axis(p, v.classes[t][:, :, None], 2)[:, :, 0])
    assert np.allclose(A.log_chosen(w, v.prior, x, v.classes[t], t != A.PAD)[t != A.PAD], want[t != A.PAD], atol=1e-3)


def test_attention_is_causal_and_ignores_padding():
    v, w = vocabulary(), A.initial()
    w["group"] += 0.3 * np.random.default_rng(2).standard_normal(w["group"].shape).astype(np.float32)
    x = np.random.default_rng(4).integers(0, A.INPUTS, (1, A.WINDOW))
    y = x.copy()
    y[0, 40:] = 1
    a, b = (A.forward(w, v.prior, z)[0] for z in (x, y))
    assert np.allclose(a[:40 - A.CONTEXT], b[:40 - A.CONTEXT], atol=1e-6) and not np.allclose(a[-1], b[-1], atol=1e-6)


def test_gradient():
    v, w, rng = vocabulary(), A.initial(), np.random.default_rng(5)
    w = {k: (x + 0.1 * rng.standard_normal(x.shape)).astype(np.float64) for k, x in w.items()}
    x, t = rng.integers(0, A.INPUTS, (2, A.WINDOW)), rng.integers(0, A.CLASSES, (2, A.FRESH))
    weight, prior = np.ones(t.shape), A.two_levels(v.bigram.astype(np.float64))

    def loss():
        p = A.forward(w, prior, x)
        return -np.log(np.take_along_axis(p, t[:, :, None], 2)).mean()

    g = A.gradient(w, prior, x, t, weight)
    for k in A.SHAPES:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = w[k][at]
        w[k][at] = keep + 1e-4
        up = loss()
        w[k][at] = keep - 1e-4
        down = loss()
        w[k][at] = keep
        assert math.isclose((up - down) / 2e-4, g[k][at], rel_tol=2e-2, abs_tol=1e-6), k


def test_windows_hold_each_token_once():
    for n in (1, 5, A.FRESH, A.FRESH + 1, 500):
        ids = np.arange(n)
        z = A.windows(ids)
        targets = z[:, A.CONTEXT + 1:]
        assert targets[targets != A.PAD].tolist() == ids.tolist() and z.shape[1] == A.WINDOW + 1
        assert z[0, A.CONTEXT] == A.END


def test_training_beats_the_bigram():
    """On ids whose next value depends on the one two steps back, attention lowers the loss."""
    v, rng = vocabulary(), np.random.default_rng(6)
    alone = np.flatnonzero(np.bincount(v.classes[:A.IDS], minlength=A.CLASSES)[v.classes[:A.IDS]] == 1)[:20]
    ids = list(alone[:2])
    for _ in range(6000):
        ids.append(alone[(int(np.flatnonzero(alone == ids[-2])[0]) * 7 + 3) % 20] if rng.random() < 0.9 else alone[rng.integers(20)])
    z = A.windows(np.array(ids))
    w, adam = A.initial(), A.Adam(1e-2)
    before = A.target_scores(w, v, z).mean()
    for _ in range(12):
        for i in range(0, len(z) - 1, 16):
            t = z[i:i + 16, A.CONTEXT + 1:]
            adam.step(w, A.gradient(w, v.prior, v.inputs[z[i:i + 16, :-1]], v.classes[t], (t != A.PAD).astype(np.float32)))
    assert A.target_scores(w, v, z).mean() > before + 0.2


def test_every_training_text_gives_gradients(spark):
    """All ids of all training documents are targets once, and a document of one short segment moves the weights."""
    data = corpus.rows(4)
    docs = corpus.frame(spark, data)
    kept = [t or "" for i, t in data if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    dealt = [r["text"] for k in range(A.ROUNDS) for r in A.training_documents(docs, k).collect()]
    assert Counter(dealt) == Counter(kept)
    want = Counter(x for t in kept for x in [*A.speller().spell(t.encode().translate(LOWER).split()).tolist(), A.END])
    seen = Counter()
    for z in A.batches_of(A.document_windows(dealt)):
        assert len(z) <= A.BATCH
        seen.update(z[:, A.CONTEXT + 1:][z[:, A.CONTEXT + 1:] != A.PAD].tolist())
    assert seen == want
    for i in [i for i in range(8) if zlib.crc32(str(i).encode()) % 5 != 1][:3]:
        assert np.abs(A.train(corpus.frame(spark, [(i, "a few short words")]), vocabulary())["group"]).max() > 0


def test_bigrams_count_neighbours_across_words(spark):
    """Pairs over word borders are counted in whole texts, so a fixed order of words shows in the bigram."""
    one = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1]
    docs = corpus.frame(spark, [(i, "the river the stone " * 30 if i % 2 else "of light of " * 30) for i in one])
    v = A.gather_vocabulary(docs, A.word_counts(docs), len(one))
    the, river, stone, light = (int(A.speller().spell([w])[0]) for w in (b"the", b"river", b"stone", b"light"))
    p = np.exp(v.bigram[v.inputs[the]])
    assert p[v.classes[river]] > 0.4 and p[v.classes[stone]] > 0.4 and p[v.classes[light]] < 0.02


def test_weight_is_fitted_on_training_texts(spark):
    """The best weight of all training rows is taken; held-out rows have no say."""
    ids = sorted(range(20), key=lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    rows = spark.createDataFrame([(0, ids[0], [-3.0 - abs(k - 6) for k in range(len(A.WEIGHTS))]), (1, ids[-1], [-9.0 * k for k in range(len(A.WEIGHTS))])],
                                 "row long, doc_id long, fit_scores array<double>")  # the second is held out
    none = spark.createDataFrame([], "row long, c long, ids double")
    assert A.fitted_weight(rows, none, lambda m: A.F.col("ids") * m) == 6


def test_mixtures_equal_plain_sums():
    rng = np.random.default_rng(8)
    ids, share = -rng.random(77) * 30, -rng.random(77) * 8
    share[::5] = -np.inf
    want = [np.log10(m * 10 ** ids + (1 - m) * 10 ** share).sum() for m in A.WEIGHTS]
    assert np.allclose(A.mixtures(ids, share), want, rtol=1e-12) and A.mixtures(ids[:0], share[:0]).tolist() == [0.0] * len(A.WEIGHTS)


def test_score_by_brute_force(spark):
    """The whole score on a tiny vocabulary, from the forward pass and plain logarithms."""
    docs = [(i, t) for i, t in enumerate(["the river the stone", "the stone of light", "of light the river river", "The the the", "unseenword the", None, "river river"])]
    frame = corpus.frame(spark, docs)
    got = {r["doc_id"]: r["score"] for r in A.score_documents(frame).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: (t or "").lower().encode().split() for i, t in docs}
    counts = A.word_counts(frame)
    n_docs = sum(not out(i) for i in words)
    voc = A.gather_vocabulary(frame, counts, n_docs)
    model = A.train(frame, voc)
    c = Counter(w for i, ws in words.items() if not out(i) for w in [*ws, None])
    norm = sum(c.values()) + 0.5 * (len(c) + 1)

    def by_ids(ws):
        parts = [A.speller().spell([w]).tolist() for w in ws] + [[A.END]]
        z = A.windows(np.array([x for part in parts for x in part]))
        t = z[:, A.CONTEXT + 1:]
        p = A.forward(model, voc.prior, voc.inputs[z[:, :-1]])
        each = (np.log10(np.take_along_axis(p, voc.classes[t][:, :, None], 2)[:, :, 0]) + voc.inside[t])[t != A.PAD].tolist()
        return [sum(each.pop(0) for _ in part) for part in parts]

    def total(i, m, own):
        s = 0.0
        for w, x in zip([*words[i], None], by_ids(words[i])):
            n = c[w] - own
            s += math.log10(m * 10 ** x + ((1 - m) * (n + 0.5) / (norm - own) if n > 0 else 0))
        return s

    best = max(A.WEIGHTS, key=lambda m: sum(total(i, m, 1) for i in words if not out(i)))
    for i in words:
        assert math.isclose(got[i], total(i, best, 0), rel_tol=1e-4), i


def test_mixtures_of_many_texts():
    """Each text's sums are its own, also of texts without words or without shares."""
    rng = np.random.default_rng(11)
    text = np.repeat(np.arange(6), [0, 40, 1, 0, 16, 33])
    ids, share = -rng.random(len(text)) * 30, -rng.random(len(text)) * 8
    share[text == 2], share[::7] = -np.inf, -np.inf
    got = A.mixtures_each(ids, share, text, 6)
    for t in range(6):
        assert np.allclose(got[t], [np.log10(m * 10 ** ids[text == t] + (1 - m) * 10 ** share[text == t]).sum() for m in A.WEIGHTS], rtol=1e-12)


def test_word_counts_are_added_up(spark, monkeypatch):
    """Counts that leave a task in parts, because of the bound on its words, are the whole counts."""
    monkeypatch.setattr(A, "CACHE_WORDS", 3)
    data = corpus.rows(5)
    want = Counter(w.decode() for i, t in data if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in (t or "").encode().translate(LOWER).split())
    rows = A.word_counts(corpus.frame(spark, data)).collect()
    assert {r["word"]: r["c"] for r in rows} == want and len(rows) == len(want)


def test_every_id_has_its_own_query():
    """The id two before each place changes what is found there: no place goes without a query of its own."""
    v, w, rng = vocabulary(), A.initial(), np.random.default_rng(12)
    w["group"] += 0.3 * rng.standard_normal(w["group"].shape).astype(np.float32)
    x = rng.integers(0, A.INPUTS, (1, A.WINDOW))
    plain = A.attended(w, x)[0][0]
    for at in range(A.CONTEXT, A.WINDOW):
        y = x.copy()
        y[0, at - 2] = (x[0, at - 2] + 1) % A.INPUTS
        assert not np.allclose(A.attended(w, y)[0][0, at - A.CONTEXT], plain[at - A.CONTEXT], atol=1e-6), at
