"""Learned decision lists over text statistics (DataFrame functions only).

Sequential covering: a rule is a conjunction of threshold tests, grown one test at a time by
information gain on two thirds of the labelled rows, pruned on the remaining third, and kept while it
is precise there; the rows it covers leave, and the next rule is learned. Every step is one
aggregation over the labelled statistics that returns counts per feature and threshold, a table whose
size depends on neither the corpus nor the sample. The list is emitted as an ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, read, words_of, written
from .registry import query

WINDOW = 8
MAX_LABELLED = 20_000  # bound of the labelled sample the list is fitted on
THRESHOLDS = 24
MAX_RULES = 12
MAX_TESTS = 4
MIN_PRECISION = 0.95
MIN_SUPPORT = 5


def _repeated_words(t: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside 8-word windows that occur twice or more in the text.

    Hashes of the windows find the texts that can have repeats; in those the windows themselves are
    compared, sorted, so the work stays near linear in the words.
    """
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("_starts", starts)
    t = t.withColumn("_hashes", F.transform("_starts", lambda i: F.xxhash64(F.slice("words", i + 1, WINDOW))))
    window = lambda i: F.array_join(F.slice("words", i + 1, WINDOW), " ")  # noqa: E731  words have no blanks
    pairs = F.array_sort(F.transform("_starts", lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    t = t.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs))
    same = lambda x, k, step: F.coalesce(F.get("_sorted", k + step)["w"] == x["w"], F.lit(False))
    hits = F.filter("_sorted", lambda x, k: same(x, k, -1) | same(x, k, 1))
    # the row number keeps filters on the result above this step: pushed below, they would repeat it inside lambdas
    t = t.withColumns({"_hits": F.array_sort(F.transform(hits, lambda x: x["i"])), "_row": F.monotonically_increasing_id()})
    spans = F.transform("_hits", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_hits", k + 1) - i, F.lit(WINDOW))))
    total = F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return t.withColumn("n_repeat_words", F.when(F.col("_row") >= 0, total).otherwise(0))


def text_statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the counts of the base rule and a few more, over whole texts (null text: no words).

    ``carry`` names columns of the input to pass on, in the struct ``row``.
    """
    t = id_and_text(docs) if not carry else docs.select(
        F.struct(*carry).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = lambda c: c.cast("long")
    t = t.select(*(["row"] if carry else []), "doc_id", "text", words_of(F.col("text")).alias("words"),
                 F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                 long(F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
                 long(F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))).alias("n_upper"),
                 long(F.length(F.regexp_replace("text", r"[^!?]+", ""))).alias("n_marks"))
    t = t.withColumn("n_words", long(F.size("words"))).withColumn("word_chars", long(F.length(F.array_join("words", ""))))
    t = t.withColumn("n_lines", long(F.size("lines"))).withColumn("n_dup_lines", long(F.size("lines") - F.size(F.array_distinct("lines"))))
    return _repeated_words(t).select(*(["row"] if carry else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "n_upper", "n_marks", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that do not grow with the length of a text; 0 where there are no words."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"word_length": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
            "upper_share": per("n_upper", "word_chars"), "marks_per_word": per("n_marks", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"),
            "words_per_line": per("n_words", "n_lines")}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = features()[self.feature]
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


def emit(rules: list[Rule], hit: Column, default: Column) -> Column:
    """The list as one ordered conditional expression: the first rule that matches decides."""
    out = None
    for rule in rules:
        out = F.when(matches(rule), hit) if out is None else out.when(matches(rule), hit)
    return default if out is None else out.otherwise(default)


def labelled_statistics(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """Statistics and ``bad`` of at most ``bound`` labelled documents, chosen by a hash of doc_id."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).alias("bad"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    known = written(known, "labelled")
    return text_statistics(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")).join(known, "doc_id")


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    info = lambda p, n: math.log2(p / (p + n)) if p else -math.inf
    return p1 * (info(p1, n1) - info(p0, n0)) if p1 else 0.0


def learn_rules(stats: DataFrame, max_rules: int = MAX_RULES, max_tests: int = MAX_TESTS, min_precision: float = MIN_PRECISION,
                min_support: int = MIN_SUPPORT, n_thresholds: int = THRESHOLDS) -> list[Rule]:
    """Rules for ``bad`` rows of a labelled table; an empty or one-sided table teaches none."""
    names = list(features())
    train = stats.filter(~base_failed()).select(*stats.columns, *(c.alias(f"f_{k}") for k, c in features().items()),
                                                (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("prune"))
    train = written(train, "rule-training")
    points = [i / n_thresholds for i in range(1, n_thresholds)]
    cuts = train.agg(*(F.percentile_approx(f"f_{k}", points, 10_000).alias(k) for k in names),
                     *(F.percentile_approx(F.when(F.col("bad"), F.col(f"f_{k}")), points, 10_000).alias(f"b_{k}") for k in names)).first()
    cuts = {k: sorted({*(cuts[k] or ()), *(cuts[f"b_{k}"] or ())}) for k in names}
    # the number of thresholds below a value, per feature: all the growing needs
    below = lambda k: F.size(F.filter(F.array(*map(F.lit, cuts[k])), lambda c: F.col(f"f_{k}") > c)) if cuts[k] else F.lit(0)
    binned = written(train.select("bad", "prune", *(below(k).alias(k) for k in names)), "rule-bins")

    def on_bins(rule: Rule) -> Column:
        out = F.lit(True)
        for t in rule:
            at = cuts[t.feature].index(t.threshold)
            out = out & (F.col(t.feature) > at if t.above else F.col(t.feature) <= at)
        return out

    def grow(rest: Column) -> Rule:
        rule: Rule = ()
        while len(rule) < max_tests:
            cells = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("bin")) for k in names))).alias("c")
            found = (binned.filter(~F.col("prune") & rest & on_bins(rule)).select("bad", cells)
                     .groupBy("c.feature", "c.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect())
            count = {k: [[0, 0] for _ in range(len(cuts[k]) + 1)] for k in names}
            for r in found:
                count[r["feature"]][r["bin"]] = [r["p"], r["n"]]
            p0, n0 = (sum(c[i] for c in count[names[0]]) for i in (0, 1))
            if p0 == 0 or n0 == 0:
                break
            best, best_gain = None, 0.0
            for k in names:
                p = n = 0
                for at, threshold in enumerate(cuts[k]):
                    p, n = p + count[k][at][0], n + count[k][at][1]
                    for above, (p1, n1) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        gain = _gain(p0, n0, p1, n1) if p1 >= min_support else 0.0
                        if gain > best_gain + 1e-9:
                            best, best_gain = Test(k, above, threshold), gain
            if best is None:
                break
            rule = (*rule, best)
        return rule

    rules: list[Rule] = []
    rest = F.lit(True)
    while len(rules) < max_rules:
        rule = grow(rest)
        if not rule:
            break
        cuts_at = range(1, len(rule) + 1)
        held = binned.filter(F.col("prune") & rest).agg(*(F.count_if(on_bins(rule[:i]) & F.col("bad")).alias(f"p{i}") for i in cuts_at),
                                                        *(F.count_if(on_bins(rule[:i]) & ~F.col("bad")).alias(f"n{i}") for i in cuts_at)).first()
        worth = {i: (held[f"p{i}"] - held[f"n{i}"]) / max(1, held[f"p{i}"] + held[f"n{i}"]) for i in cuts_at}
        keep = max(cuts_at, key=lambda i: (worth[i], -i))
        p, n = held[f"p{keep}"], held[f"n{keep}"]
        if p < min_support or p < min_precision * (p + n):
            break
        rule = rule[:keep]
        rules.append(rule)
        rest = rest & ~on_bins(rule)
    return rules


def judge_quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """Statistics of every row with base_failed and kept; rows repeat as they do in the input.

    Without usable labels the list is empty and only the base rule rejects. Null text has no words.
    """
    rules = learn_rules(labelled_statistics(docs, labels, bound))
    verdict = emit(rules, F.lit(False), F.lit(True))
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict)


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """The rows that pass, with all their columns."""
    rules = learn_rules(labelled_statistics(docs, labels, bound))
    passed = ~base_failed() & emit(rules, F.lit(False), F.lit(True))
    return text_statistics(docs, carry=docs.columns).filter(passed).select(*(F.col("row")[c].alias(c) for c in docs.columns))


RULE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@query()
def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(*RULE_COLUMNS)
