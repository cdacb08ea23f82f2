"""Small corpora with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, n int, size int, bucket int, "
          "anchor string, shard int, word string, row int, digest string")
PASSAGE = " ".join(f"shared passage word{i}" for i in range(30))


def sentence(rng, n):
    return " ".join(rng.choice(["the", "and", "stone", "river", "Light", "über", "naïve", "x1", "tree,", "Sun."]) + str(rng.randrange(40)) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts += [texts[3], texts[3].upper(), texts[5], texts[5]]  # copies, one up to case
    words = sentence(rng, 100).split()
    for k in range(5):  # near copies
        w = list(words)
        w[10 * k] = "changed"
        texts.append(" ".join(w))
    texts += [PASSAGE + " " + texts[0], "start " + PASSAGE, PASSAGE, "a" * 450, "", None, " \n\t ", "one two", "one two three four five"]
    texts += ["line one\nline one\nline two\n\nline one", "# $ % & | < > * " * 8, " ".join(["again and again it goes on so long"] * 20), "日本語 text é\U0001f600 <|endoftext|> ▁x"]
    texts.append(sentence(rng, 9000))  # long
    out = [(i, t) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[1]), (None, None), (7, "another text under a known id")]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", None if i is None else f"src{i % 3}", len(t or ""), "k", 1, 2, 3, "a", 4, "w", 5, "d") for i, t in data], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
