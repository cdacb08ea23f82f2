"""Quality rules, shards, fixity, token files and packing on hard rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import fixity as W
from newsflow.llm import grammar_ids as G
from newsflow.llm import packing as K
from newsflow.llm import pieces as S
from newsflow.llm import quality_rules as Q
from newsflow.llm import sharding as H
from newsflow.llm.tokens import tokenizer_path

from . import corpus

DATA = corpus.rows(2)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def statistics(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    got = Q.text_statistics(corpus.frame(spark, DATA)).select("doc_id", *Q.RULE_COLUMNS[1:6]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *statistics(t)) for i, t in DATA), key=repr)


def test_rules_are_learned_and_emitted(spark):
    good = [(i, corpus.sentence(np_random(i), 60)) for i in range(200)]
    bad = [(i, " ".join(w + "###" for w in corpus.sentence(np_random(i), 60).split())) for i in range(200, 300)]
    loud = [(i, corpus.sentence(np_random(i), 60).upper() + "!" * 60) for i in range(300, 400)]
    docs = corpus.frame(spark, good + bad + loud + [(None, None), (1000, "short")])
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(None, 0), (5, None)], "doc_id long, quality int")
    rules = Q.learn_rules(Q.labelled_statistics(docs, labels))
    assert rules and all(1 <= len(r) <= Q.MAX_TESTS for r in rules)
    kept = {r["doc_id"] for r in Q.judge_quality(docs, labels).collect() if r["kept"]}
    assert kept == set(range(200))
    rows = Q.keep_good(docs, labels)
    assert rows.columns == docs.columns and {r["doc_id"] for r in rows.collect()} == kept
    assert Q.judge_quality(docs, labels.limit(0)).filter("kept").count() == 400  # no labels: the base rule alone
    assert Q.judge_quality(corpus.empty(spark), labels).count() == 0


def np_random(seed):
    import random
    return random.Random(seed)


def test_shards(spark):
    got = H.interleave(corpus.frame(spark, DATA), shards=7, rows_per_bucket=10).collect()
    assert len(got) == len(DATA)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    n, each = Counter(r["source"] for r in got), Counter((r["source"], r["shard"]) for r in got)
    assert all(abs(each[a, s] - n[a] / 7) <= 2 for a in n for s in range(7))
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in DATA), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    again = H.interleave(corpus.frame(spark, DATA), shards=7, rows_per_bucket=1000).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)  # buckets do not matter
    assert H.interleave(corpus.empty(spark)).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(300)] + [(None, None, None), (4, "http://x/4", "<p>4</p>")],
                                  "page_id long, url string, html string")
    primary = W.write_archives(pages, records=64)
    one = W.audit(primary, primary, records=64, fanout=4)
    assert one.count() == 302 and one.filter("state <> 'ok'").count() == 0
    r = F.col("record_no")
    replica = primary.filter(r != 5).withColumn("record", F.when(r == 17, F.concat("record", F.lit("x"))).otherwise(F.col("record")))
    replica = replica.unionByName(primary.filter(r == 0).withColumn("record_no", F.lit(63)).filter("archive = 1e9"))
    found = {(x["archive"], x["record_no"]): x["state"] for x in W.audit(primary, replica, records=64, fanout=4).collect()}
    keys = [(x["archive"], x["record_no"]) for x in primary.select("archive", "record_no").collect()]
    assert found == {k: {5: "missing", 17: "corrupt"}.get(k[1], "ok") for k in keys}
    rows = W.audit(primary, primary, records=64, fanout=4).join(primary.select("archive", "record_no", "record"), ["archive", "record_no"]).collect()
    assert all(x["record_sha256"] == hashlib.sha256(x["record"].encode()).hexdigest() and x["length"] == len(x["record"].encode()) for x in rows)
    assert W.audit(W.write_archives(pages.limit(0)), W.write_archives(pages.limit(0))).count() == 0
    extra = primary.limit(1).withColumn("record_no", F.lit(64 * 1000))
    assert W.audit(primary, primary.unionByName(extra), records=64, fanout=4).filter("state = 'extra'").count() <= 1


def test_grammar_files(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    blocks = G.write_blocks(corpus.frame(spark, DATA), block_tokens=500)
    got = Counter(map(tuple, G.read_blocks(blocks).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    at, want = 0, Counter()
    for i, t in sorted(DATA, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[(i, at, len(ids), crc(ids))] += 1
        at += len(ids)
    assert got == want
    assert G.read_blocks(G.write_blocks(corpus.empty(spark))).count() == 0


@pytest.mark.parametrize("kind", ["random", "periodic", "one", "none", "text"])
def test_grammar_round_trip(kind):
    rng = np.random.default_rng(4)
    ids = {"random": rng.integers(0, 49408, 5000), "periodic": np.tile([5, 5, 5, 7], 3000), "one": np.full(4001, 9), "none": np.empty(0),
           "text": rng.zipf(1.3, 20000) % 300}[kind].astype(np.uint16)
    data = G.pack_block(ids, np.array([len(ids)], np.uint32))
    block = G.Block(data)
    assert (block.decode() == ids).all() and len(block.decode()) == len(ids)
    for start in range(0, len(ids), max(1, len(ids) // 13)):
        assert (block.decode(start, 50 if start + 50 <= len(ids) else None) == ids[start:start + 50 if start + 50 <= len(ids) else None]).all()
    if kind in ("periodic", "one"):
        assert len(block.seq) < len(ids) / 8 and block.lengths.max() > 8
    with pytest.raises(ValueError):
        G.Block(b"XXXX" + data[4:])


def test_packing(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = K.pack_documents(corpus.frame(spark, DATA)).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for used in sequences.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 2048
    want, total = defaultdict(list), 0
    for i, t in DATA:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want[i] += [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        total += len(ids)
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    assert len(sequences) <= -(-total // 2048) + 1
    assert K.pack_documents(corpus.empty(spark)).count() == 0


def test_sum_of_squares_by_definition():
    """Each choice is one of those that make the sum of squares smallest among the open sequences."""
    lengths = np.random.default_rng(8).integers(1, 21, 300)
    place, offset, used = K.sum_of_squares(lengths, 20)
    gaps = {}
    for size, b, off in zip(lengths.tolist(), place.tolist(), offset.tolist()):
        fits = {g for g in gaps.values() if g >= size}
        if not fits:
            assert b not in gaps and off == 0
            gaps[b] = 20
        else:
            def cost(g):
                rest = list(gaps.values())
                rest.remove(g)
                return sum(n * n for n in Counter(x for x in [*rest, g - size] if x).values())
            assert off == 20 - gaps[b] and cost(gaps[b]) == min(map(cost, fits))
        gaps[b] -= size
    assert used == len(gaps) and min(gaps.values()) >= 0


def test_pieces(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    data = DATA + [(900, "  two  blanks "), (901, "▁x <s> </s> <unk> <0x41>"), (902, "\x00\x01 null"), (903, " " * 37 + "end")]
    got = S._encoded(corpus.frame(spark, data), None, True).collect()
    want = []
    for i, t in data:
        ids = library.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    full = S.encode_pieces(corpus.frame(spark, data[:3])).collect()
    assert [library.encode(t) for _, t in data[:3]] == [r["ids"] for r in full] and all(r["agrees"] for r in full)
    assert S.encode_pieces(corpus.empty(spark)).count() == 0


def test_agendas_side_by_side_and_on_a_heap():
    import random
    agenda = S.agenda(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = ["".join(rng.choice("theanrdiolnsEé▁\n日") for _ in range(rng.randrange(1, 25))) for _ in range(500)] + ["▁▁▁▁▁▁▁", "aaaaaaaaa", "e"]
    assert agenda.merge_rows(words) == [agenda.merge(w) for w in words]
    assert agenda.library.encode(["x" * 200, "é日x" * 30]) == [list(map(int, s[:-1].split(","))) for s in agenda.encode(["x" * 200, "é日x" * 30])]


def test_grammar_runs_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    phrase = np.tile(rng.integers(0, 49_000, 64), 4000).astype("<u2")
    rules, seq = G.repair(phrase)
    assert len(seq) < 20 and len(rules) < 140
    for ids in (phrase, np.zeros(1000, "<u2"), rng.integers(0, 30, 50_000).astype("<u2"), (rng.zipf(1.3, 30_000) % 5000).astype("<u2")):
        rules, seq = G.repair(ids)
        assert (G.Block(G.pack_block(ids, np.array([len(ids)]))).decode() == ids).all()
        pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
        overlapping = max((n for (a, b), n in pairs.items() if a != b), default=0)
        assert len(rules) == G.SYMBOLS - G.VOCABULARY or overlapping < G.LEAST_COUNT
