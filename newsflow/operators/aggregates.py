"""Feedback, outcome and health aggregates."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import signal_words as S
from ..functions.text import once
from ..runtime import checkpoint
from .windows import top_per_key


def _hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * 3600))


def rounded(c: Column, digits: int) -> Column:
    return F.round(c, digits)


# --- learning from feedback --------------------------------------------------------------------
def source_weights(feedback: DataFrame, news: DataFrame, as_of: Column, prior: float = 0.05,
                   days: int = 7, learned: DataFrame | None = None) -> DataFrame:
    """New authority per source from thumbs votes of the last days (three votes or more).

    ``learned`` (source, weight) replaces the prior where a source has one.
    """
    votes = (feedback.filter(F.col("ts") > as_of - _hours(24 * days))
             .filter(F.col("reaction").isin("thumbs_up", "thumbs_down"))
             .groupBy("news_id").agg(F.sum((F.col("reaction") == "thumbs_up").cast("int")).alias("up"),
                                     F.count("*").alias("n")))
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    per = (votes.join(news.select("news_id", source.alias("source")), "news_id")
           .groupBy("source").agg(F.sum("up").alias("up"), F.sum("n").alias("votes")).filter("votes >= 3"))
    current = F.lit(prior)
    if learned is not None:
        old = learned.select(F.lower("source").alias("_s"), F.col("weight").alias("_w"))
        per = per.join(old, F.lower("source") == F.col("_s"), "left")
        current = F.coalesce("_w", F.lit(prior))
    ratio = F.col("up") / F.col("votes")
    weight = (F.when(ratio >= 0.8, F.least(current * 1.5, F.lit(0.15)))
              .when(ratio <= 0.3, F.greatest(current * 0.7, F.lit(0.01)))
              .otherwise(F.greatest(F.lit(0.01), F.least(F.lit(0.15), current + (ratio - 0.5) * 0.05))))
    return per.select("source", "up", "votes", F.round(weight, 4).alias("weight"))


def topic_weights(feedback: DataFrame, news: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Share of seen tags the user engaged with (tags seen twice or more)."""
    per_news = (feedback.filter(F.col("ts") > as_of - _hours(24 * days)).groupBy("news_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("reaction").isin("thumbs_up", "analyze").cast("int")).alias("e")))
    tags = news.select("news_id", F.explode("macro_tags").alias("topic")).withColumn("topic", F.trim("topic"))
    per = (per_news.join(tags.filter("topic <> ''"), "news_id").groupBy("topic")
           .agg(F.sum("n").alias("seen"), F.sum("e").alias("engaged")).filter("seen >= 2"))
    return per.withColumn("weight", F.round(F.col("engaged") / F.col("seen"), 4))


def push_threshold(feedback: DataFrame, news: DataFrame, as_of: Column, current: float = 0.30,
                   days: int = 3) -> DataFrame:
    """One row: pushes, reactions, the engagement rate and the adjusted threshold."""
    since = as_of - _hours(24 * days)
    pushed = F.col("status").isin("fast_pushed", "deep_pushed")
    counts = (news.filter(pushed & (F.col("captured_at") > since)).select(F.lit(1).alias("p"), F.lit(0).alias("e"))
              .unionByName(feedback.filter(F.col("ts") > since).select(F.lit(0).alias("p"), F.lit(1).alias("e"))))
    one = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pushed"),
                     F.coalesce(F.sum("e"), F.lit(0)).alias("engaged"))
    rate = F.try_divide("engaged", "pushed")
    new = (F.when(rate >= 0.5, F.greatest(F.lit(current - 0.02), F.lit(0.15)))
           .when(rate <= 0.1, F.least(F.lit(current + 0.02), F.lit(0.50))).otherwise(F.lit(current)))
    return one.select("pushed", "engaged", F.round(rate, 4).alias("rate"), F.round(new, 4).alias("threshold"))


def prediction_accuracy(feedback: DataFrame) -> DataFrame:
    right = F.sum((F.col("reaction") == "prediction_right").cast("int"))
    wrong = F.sum((F.col("reaction") == "prediction_wrong").cast("int"))
    return feedback.agg(F.coalesce(right, F.lit(0)).alias("right"), F.coalesce(wrong, F.lit(0)).alias("wrong"),
                        F.round(F.try_divide(right * 100.0, right + wrong), 1).alias("accuracy_pct"))


# --- predictions against outcomes ---------------------------------------------------------------
def _max_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("assessment_id").agg(F.max("actual_score").alias("actual"))


def outcomes_by_category(assess: DataFrame, outcomes: DataFrame, n: int = 20) -> DataFrame:
    """Newest n assessments per category with their largest measured score."""
    joined = assess.join(_max_outcomes(outcomes), assess["id"] == F.col("assessment_id"))
    return top_per_key(joined.select("id", "category", "impact_score", "actual", "created_at"),
                       ["category"], [F.desc("created_at"), F.desc("id")], n)


def category_bias(assess: DataFrame, outcomes: DataFrame, n: int = 20, minimum: int = 5,
                  clamp: float = 5.0, hint: float = 2.0) -> DataFrame:
    """Mean over-estimate per category, clamped; categories with few samples give 0."""
    recent = outcomes_by_category(assess, outcomes, n)
    usable = F.col("actual") >= 0
    per = recent.groupBy("category").agg(
        F.count("*").alias("samples"),
        F.avg(F.when(usable, F.col("impact_score") - F.col("actual"))).alias("m"))
    bias = F.when((F.col("samples") < minimum) | F.col("m").isNull(), F.lit(0.0)).otherwise(
        F.least(F.greatest(F.col("m"), F.lit(-clamp)), F.lit(clamp)))
    text = F.when(F.abs("bias") >= hint, F.concat(
        F.lit("Tend to "), F.when(F.col("bias") > 0, "over-estimate").otherwise("under-estimate"),
        F.lit(" "), F.col("category"), F.lit(" events by ~"),
        F.bround(F.abs("bias"), 0).cast("int").cast("string"), F.lit(" points")))
    return per.select("category", "samples", F.round(bias, 4).alias("bias")).withColumn("hint", text)


def _ema_step(b: int, x: int, tenths: int) -> int:
    """Moving average in whole cents, rounded half away from zero on exact tenths."""
    raw = b * (10 - tenths) + x * tenths
    return (raw + 5) // 10 if raw >= 0 else -((5 - raw) // 10)


def _ema_chunks(tenths: int, low: int, high: int, narrow: int = 64):
    """Reduce each run of rows of a category, in time order, to a step map.

    The update is monotone and contracting. ``head`` holds the first rows, as many as it takes until the images
    of the lowest and the highest possible bias are at most ``narrow`` apart; ``outs`` says where each value
    from ``base`` on ends after all rows. ``started`` is the bias if the run's first row opens the category.
    """
    import pyarrow as pa

    def run(batches):
        done, now = [], None

        def close():
            if now:
                done.append([now[c] for c in ("category", "part", "samples", "started", "head", "base", "outs")])

        for batch in batches:
            for category, part, e in zip(*(batch.column(c).to_pylist() for c in ("category", "part", "e"))):
                if now is None or category != now["category"]:
                    close()
                    now = {"category": category, "part": part, "samples": 0, "started": None, "head": [], "base": low, "top": high, "outs": None}
                now["samples"] += 1
                now["started"] = e if now["started"] is None else _ema_step(now["started"], e, tenths)
                if now["outs"] is None:
                    now["head"].append(e)
                    now["base"], now["top"] = _ema_step(now["base"], e, tenths), _ema_step(now["top"], e, tenths)
                    if now["top"] - now["base"] <= narrow:
                        now["outs"] = list(range(now["base"], now["top"] + 1))
                elif now["outs"][0] == now["outs"][-1]:
                    now["outs"] = [_ema_step(now["outs"][0], e, tenths)] * len(now["outs"])
                else:
                    now["outs"] = [_ema_step(b, e, tenths) for b in now["outs"]]
        close()
        columns = list(zip(*done)) or [[]] * 7
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)],
                                         ["category", "part", "samples", "started", "head", "base", "outs"])
    return run


def ema_bias(assess: DataFrame, outcomes: DataFrame, alpha_tenths: int = 3) -> DataFrame:
    """Moving bias per category, rounded to cents at every step, plus the sample count.

    Rows are sorted by category and time over range partitions, so a category of any size lies in several.
    Each partition turns its run of a category into a step map of bounded size, and the maps of a category,
    at most one a partition, are composed in order.
    """
    rows = (assess.join(outcomes, assess["id"] == outcomes["assessment_id"])
            .filter("actual_score >= 0")
            .select(F.col("category").cast("string").alias("category"), outcomes["collected_at"].alias("at"), assess["id"].alias("id"),
                    outcomes["window"].alias("w"),
                    F.round((F.col("impact_score") - F.col("actual_score")) * 100).cast("bigint").alias("e")))
    rows = checkpoint(rows.filter("e is not null"))
    ends = rows.agg(F.min("e").alias("low"), F.max("e").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    order = ["category", "at", "id", "w"]
    runs = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("category", F.spark_partition_id().alias("part"), "e")
            .mapInArrow(_ema_chunks(alpha_tenths, low, high),
                        "category string, part int, samples long, started long, head array<long>, base long, outs array<long>"))

    def compose(maps):
        maps = maps.sort_values("part")
        bias = None
        for started, head, base, outs in zip(maps["started"], maps["head"], maps["base"], maps["outs"]):
            if bias is None:
                bias = int(started)
                continue
            for x in head:
                bias = _ema_step(bias, int(x), alpha_tenths)
            if outs is not None:
                bias = int(outs[bias - int(base)])
        return maps[["category"]].head(1).assign(bias=bias / 100.0, samples=int(maps["samples"].sum()))

    return runs.groupBy("category").applyInPandas(compose, "category string, bias double, samples long")


def mae_by_version(assess: DataFrame, outcomes: DataFrame) -> DataFrame:
    joined = assess.join(outcomes, assess["id"] == outcomes["assessment_id"]).filter("actual_score >= 0")
    return joined.groupBy("version").agg(
        F.round(F.avg(F.abs(F.col("impact_score") - F.col("actual_score"))), 2).alias("mae"),
        F.count("*").alias("samples"))


def impact_stats(assess: DataFrame, outcomes: DataFrame) -> DataFrame:
    total = assess.agg(F.count("*").alias("total"), F.lit(0).cast("bigint").alias("with_outcomes"))
    measured = outcomes.agg(F.lit(0).cast("bigint").alias("total"),
                            F.count_distinct("assessment_id").alias("with_outcomes"))
    return (total.unionByName(measured).agg(F.sum("total").alias("total"),
                                            F.sum("with_outcomes").alias("with_outcomes"))
            .withColumn("pending", F.col("total") - F.col("with_outcomes")))


def outcome_score(spx: Column, vix: Column, sectors: Column, tickers: Column, breadth: Column) -> Column:
    """Measured impact 0..100 from index, sector and ticker moves."""
    moved = F.size(F.filter(F.map_values(sectors), lambda v: F.abs(v) > 0.5))
    moves = F.map_values(tickers)
    mean = F.try_divide(F.aggregate(moves, F.lit(0.0), lambda s, v: s + F.abs(v)), F.size(moves))
    mult = (F.when(breadth == "cross_asset", 1.0).when(breadth == "broad_market", 0.85)
            .when(breadth == "sector", 0.65).when(breadth == "single_stock", 0.45).otherwise(0.7))
    one = F.lit(1.0)
    raw = (F.least(F.abs(spx) / 3, one) * 0.35 + F.least(F.abs(vix) / 15, one) * 0.20
           + F.least(F.coalesce(moved, F.lit(0)) / 6, one) * 0.20
           + F.least(F.coalesce(mean, F.lit(0.0)) / 8, one) * 0.25)
    return F.round(F.least(raw * 100 * mult, F.lit(100.0)), 1)


# --- health ------------------------------------------------------------------------------------
def health_stats(assess: DataFrame, health: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    since = as_of - _hours(hours)
    rows = (assess.filter(F.col("created_at") > since).select(F.lit(1).alias("a"), F.lit(0).alias("e"))
            .unionByName(health.filter((F.col("created_at") > since) & ~F.col("event_type").startswith("watchdog_"))
                         .select(F.lit(0).alias("a"), F.lit(1).alias("e"))))
    one = rows.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("assessments"),
                   F.coalesce(F.sum("e"), F.lit(0)).alias("errors"))
    rate = (F.col("assessments") - F.col("errors")) / F.greatest("assessments", F.lit(1)) * 100
    return one.withColumn("success_rate", F.round(rate, 1))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()])


# --- digest ------------------------------------------------------------------------------------
def digest_summary(news: DataFrame, events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    since = as_of - _hours(hours)
    recent = news.filter(F.col("captured_at") > since)
    counts = recent.agg(
        F.count("*").alias("articles"),
        F.sum((F.col("status") == "fast_pushed").cast("int")).alias("fast"),
        F.sum((F.col("status") == "deep_pushed").cast("int")).alias("deep"),
        F.sum((F.col("priority_score") >= 0.7).cast("int")).alias("urgent"),
        F.lit(0).cast("bigint").alias("events"))
    active = events.filter(F.col("is_active") & (F.col("source_count") >= 2) & (F.col("last_updated") > since))
    zero = F.lit(0).cast("bigint")
    n = active.agg(zero.alias("articles"), zero.alias("fast"), zero.alias("deep"), zero.alias("urgent"),
                   F.count("*").alias("events"))
    return counts.unionByName(n).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                                       for c in ("articles", "fast", "deep", "urgent", "events")])


def ticker_mentions(news: DataFrame, k: int = 5) -> DataFrame:
    """Top k tickers by number of mentions."""
    t = news.select(F.explode("tickers").alias("ticker")).withColumn("ticker", F.trim("ticker"))
    return (t.filter("ticker <> ''").groupBy("ticker").agg(F.count("*").alias("mentions"))
            .orderBy(F.desc("mentions"), "ticker").limit(k))


def push_latency(alerts: DataFrame) -> DataFrame:
    """Seconds from publication to push, per source."""
    s = (F.unix_micros("pushed_at") - F.unix_micros("published_at")) / 1e6
    return (alerts.filter("published_at is not null").withColumn("latency", s).groupBy("source")
            .agg(F.count("*").alias("alerts"), F.round(F.avg("latency"), 1).alias("mean_seconds"),
                 F.round(F.max("latency"), 1).alias("max_seconds")))


# --- thresholds ----------------------------------------------------------------------------------
def push_labels(feedback: DataFrame, news: DataFrame, assess: DataFrame, outcomes: DataFrame,
                newest: int = 500) -> DataFrame:
    """Labelled scores from the newest reactions and the newest measured outcomes."""
    scored = news.filter("priority_score is not null").select("news_id", "priority_score")
    react = (feedback.join(scored, "news_id")
             .select("priority_score", "reaction", "ts", "news_id")
             .orderBy(F.desc("ts"), F.desc("news_id")).limit(newest))
    voted = react.select("priority_score", F.when(F.col("reaction") == "thumbs_up", True).when(
        F.col("reaction").isin("thumbs_down", "ignore"), False).alias("should_push"), F.lit("feedback").alias("origin"))
    best = (outcomes.filter("actual_score >= 0").groupBy("assessment_id")
            .agg(F.max("actual_score").alias("actual"), F.max("collected_at").alias("at")))
    measured = (best.join(assess.select(F.col("id").alias("assessment_id"), "news_id"), "assessment_id")
                .join(scored, "news_id")
                .orderBy(F.desc("at"), F.desc("assessment_id")).limit(newest))
    moved = measured.select("priority_score", F.when(F.col("actual") >= 50, True).when(
        F.col("actual") < 20, False).alias("should_push"), F.lit("outcome").alias("origin"))
    return voted.unionByName(moved).filter("should_push is not null")


CRITICAL_GRID = [55, 60, 65, 70, 75, 80]
IMPORTANT_GRID = [35, 40, 45, 50, 55, 60]


def threshold_grid(labels: DataFrame, critical=CRITICAL_GRID, important=IMPORTANT_GRID) -> DataFrame:
    """Confusion counts, precision, recall and F1 per (critical, important) pair in hundredths.

    A label is pushed when it reaches the lower threshold, so one pass with one counter pair
    per ``important`` value serves the whole grid; labels are never multiplied.
    """
    push = F.col("should_push")
    cols = [F.sum(push.cast("int")).alias("pos"), F.sum((~push).cast("int")).alias("neg")]
    for v in important:
        hit = F.col("priority_score") >= v / 100
        cols += [F.sum((hit & push).cast("int")).alias(f"tp{v}"), F.sum((hit & ~push).cast("int")).alias(f"fp{v}")]
    cells = [F.struct(F.lit(c / 100).alias("critical"), F.lit(v / 100).alias("important"),
                      F.col(f"tp{v}").alias("tp"), F.col(f"fp{v}").alias("fp"))
             for c in critical for v in important if v < min(61, c)]
    grid = labels.agg(*cols).select("pos", "neg", F.explode(F.array(*cells)).alias("c"))
    g = grid.select("c.*", (F.col("neg") - F.col("c.fp")).alias("tn"), (F.col("pos") - F.col("c.tp")).alias("fn"))
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return (g.select("critical", "important", "tp", "fp", "tn", "fn", F.round(precision, 3).alias("precision"),
                     F.round(recall, 3).alias("recall"), F.round(f1, 3).alias("f1"))
            .orderBy(F.desc("f1"), F.desc("precision"), "critical", "important"))


def _newest_ranked(news: DataFrame, newest: int) -> DataFrame:
    """Scores of the newest rows with their 0-based descending rank; bounded by ``newest``."""
    from pyspark.sql import Window
    top = news.orderBy(F.desc("news_id")).limit(newest).select("news_id", "priority_score")
    w = Window.orderBy(F.desc("priority_score"), "news_id")
    return (top.withColumn("i", F.row_number().over(w) - 1)
            .withColumn("n", F.count("*").over(Window.partitionBy())))


def score_percentiles(news: DataFrame) -> DataFrame:
    """Score at the descending rank int(n * p), labelled by the share p above it.

    Rows are counted per distinct score first; only those counts are cumulated.
    """
    from pyspark.sql import Window
    counts = news.filter("priority_score is not null").groupBy("priority_score").agg(F.count("*").alias("c"))
    ranked = (counts.withColumn("last", F.sum("c").over(Window.orderBy(F.desc("priority_score")).rowsBetween(Window.unboundedPreceding, 0)) - 1)
              .withColumn("n", F.sum("c").over(Window.partitionBy())))
    points = [90, 80, 70, 60, 50, 40, 30, 25, 20, 10]
    at = F.array(*[F.struct(F.lit(p).alias("top_pct"),
                            F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).alias("k")) for p in points])
    wanted = ranked.withColumn("p", F.explode(at)).filter("p.k between last - c + 1 and last")
    return wanted.select("p.top_pct", F.col("priority_score").alias("score"), "n")


def bootstrap_labels(news: DataFrame, newest: int = 1000) -> DataFrame:
    """Top 5% of the newest processed scores as positives, bottom 20% as negatives."""
    ranked = _newest_ranked(news.filter("priority_score > 0 and status <> 'pending'"), newest)
    top = F.greatest(F.floor(F.col("n") * 0.05), F.lit(1))
    label = F.when(F.col("i") <= top, True).when(F.col("i") >= F.floor(F.col("n") * 0.80), False)
    return (ranked.withColumn("should_push", label).filter("should_push is not null")
            .select("news_id", "priority_score", "should_push"))


# --- evaluation of scored sets -------------------------------------------------------------------
def level_stats(scored: DataFrame, level: str = "impact", score: str = "composite") -> DataFrame:
    """Backtest block: count, mean, min and max of the score per level."""
    return scored.groupBy(level).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("avg"),
                                     F.round(F.min(score), 4).alias("min"), F.round(F.max(score), 4).alias("max"))


def backtest_report(scored: DataFrame, level_num: str = "impact_num", composite: str = "composite",
                    relevance: str = "relevance", old: str | None = None) -> DataFrame:
    """Correlations of score and level, spread of the score and strategic coverage."""
    cols = [F.count("*").alias("n"), F.round(F.corr(level_num, composite), 4).alias("corr_composite"),
            F.round(F.corr(level_num, relevance), 4).alias("corr_relevance"),
            F.round(F.stddev_samp(relevance), 4).alias("stdev_relevance"),
            F.count_distinct(F.round(relevance, 2)).alias("distinct_relevance")]
    if old:
        cols.append(F.round(F.corr(old, level_num), 4).alias("corr_old"))
    return scored.agg(*cols)


def category_coverage(scored: DataFrame, category: str = "best_category", score: str = "composite") -> DataFrame:
    return scored.filter(F.col(category).isNotNull()).groupBy(category).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 4).alias("avg"))


def push_rate(scored: DataFrame, level: str = "impact", score: str = "composite",
              push_at: float = 0.35, critical_at: float = 0.50) -> DataFrame:
    """Pushed and critical counts per level with a total row (level null)."""
    return scored.rollup(level).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 4).alias("avg"),
        F.sum((F.col(score) >= push_at).cast("int")).alias("pushed"),
        F.sum((F.col(score) >= critical_at).cast("int")).alias("critical")).withColumn(
        "push_pct", F.round(F.col("pushed") / F.col("n") * 100, 1))


def missed_cases(scored: DataFrame, score: str = "composite", push_at: float = 0.35) -> DataFrame:
    return scored.filter(F.col(score) < push_at)


def holdout_metrics(pred: DataFrame, truth: DataFrame, id_col: str = "case_id") -> DataFrame:
    """Agreement of predictions with labelled cases; recall counts alphabetic tickers only."""
    p = pred.select(id_col, F.col("intensity").alias("pi"), F.col("should_push").alias("pp"),
                    F.transform("tickers", lambda t: F.upper(t)).alias("pt"))
    t = truth.select(id_col, "intensity", "is_push", F.array_distinct(F.transform(
        F.filter("beneficiaries", lambda x: x.rlike("^[A-Za-z]")), lambda x: F.upper(x))).alias("tt"))
    hit = F.when(F.size("tt") > 0, F.size(F.array_intersect("tt", "pt")) / F.size("tt"))
    off = F.abs(F.col("pi") - F.col("intensity"))
    return t.join(p, id_col).agg(
        F.count("*").alias("n"), F.sum((off == 0).cast("int")).alias("exact"),
        F.sum((off <= 1).cast("int")).alias("within_one"),
        F.sum((F.col("pp") == F.col("is_push")).cast("int")).alias("push_match"),
        F.round(F.avg(hit), 4).alias("ticker_recall"), F.count(hit).alias("recall_n"))


def benchmark_gap(scored: DataFrame, bench: DataFrame, id_col: str = "id") -> DataFrame:
    gap = F.abs(F.col("score") - F.col("benchmark"))
    return scored.join(bench, id_col).agg(F.count("*").alias("n"), F.round(F.avg(gap), 4).alias("mean_gap"),
                                          F.round(F.max(gap), 4).alias("max_gap"))


def prompt_ab_diff(run_a: DataFrame, run_b: DataFrame, id_col: str = "case_id",
                   numeric=("impact_score", "confidence", "greed_index"),
                   text=("urgency", "sentiment"), minimum: float = 5.0) -> DataFrame:
    """Per case and field: numeric changes of at least ``minimum``, text changes, missing runs."""
    a = run_a.select(id_col, F.struct(*numeric, *text).alias("a"))
    b = run_b.select(id_col, F.struct(*numeric, *text).alias("b"))
    both = a.join(b, id_col, "full")
    cells = [F.struct(F.lit(f).alias("field"), F.lit(True).alias("num"),
                      F.col(f"a.{f}").cast("string").alias("old"), F.col(f"b.{f}").cast("string").alias("new"),
                      (F.col(f"b.{f}") - F.col(f"a.{f}")).cast("double").alias("delta")) for f in numeric]
    cells += [F.struct(F.lit(f).alias("field"), F.lit(False).alias("num"), F.col(f"a.{f}").alias("old"),
                       F.col(f"b.{f}").alias("new"), F.lit(None).cast("double").alias("delta")) for f in text]
    long = both.select(id_col, F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"),
                       F.explode(F.array(*cells)).alias("c"))
    changed = (F.col("no_a") | F.col("no_b") | (F.col("c.num") & (F.abs("c.delta") >= minimum))
               | (~F.col("c.num") & ~F.col("c.old").eqNullSafe(F.col("c.new"))))
    kind = F.when(F.col("no_a"), "old failed").when(F.col("no_b"), "new failed").otherwise("changed")
    return long.filter(changed).select(id_col, "c.field", "c.old", "c.new", "c.delta", kind.alias("kind"))


# --- text aggregates -----------------------------------------------------------------------------
def budgeted_concat(docs: DataFrame, group: str, order: list, max_chars: int = 3000, newest: int = 20,
                    id_col: str = "doc_id", kind: str = "type", body_chars: int | None = None) -> DataFrame:
    """Join the newest texts per group until the running length reaches the budget (the text
    that crosses it is still included); ``body_chars`` (200 in the described system) shortens contents."""
    from pyspark.sql import Window
    content = F.substring("content", 1, body_chars) if body_chars else F.col("content")
    body = F.coalesce(F.nullif("summary", F.lit("")), content)
    top = top_per_key(docs.withColumn("_b", body), [group], order, newest, rank="_r").filter("_b <> ''")
    before = F.coalesce(F.sum(F.length("_b")).over(
        Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = top.withColumn("_before", before).filter(F.col("_before") < max_chars)
    line = F.concat(F.lit("- ["), F.col(kind), F.lit("] "), F.col("_b"))
    return kept.groupBy(group).agg(
        F.count("*").alias("docs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("t")))),
                                 lambda s: s["t"]), "\n").alias("context"))


def lexicon_sentiment(docs: DataFrame, lexicon: dict[str, float] = S.SENTIMENT_VALENCE,
                      id_col: str = "doc_id", text: str = "text", negations=S.NEGATIONS, boosters: dict[str, float] = S.BOOSTERS) -> DataFrame:
    """Sum of word valences scaled to (-1, 1), computed per row without leaving the JVM.

    Each of the three words before a listed word counts unless it is listed itself: a booster moves the valence
    away from zero (or towards it), less the farther away it is, and a negation turns and weakens it, nearest
    word first. The words' lists are arguments, the valence table too.
    """
    def table(entries: dict[str, float]) -> Column:
        return F.from_json(F.lit(json.dumps({k: float(v) for k, v in entries.items()})), "map<string,double>")

    words = F.transform(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z'\-\s]", " "), r"\s+"), lambda w: F.btrim(w, F.lit("'")))
    df = once(docs, _words=words)
    df = once(df, _values=F.transform("_words", lambda w: F.try_element_at(table(lexicon), w)))

    def valence(i: Column) -> Column:
        v = F.get("_values", i)
        for k, share in enumerate(S.BOOSTER_SHARES, start=1):
            word = F.get("_words", i - k)
            moved = v + F.signum(v) * F.coalesce(F.try_element_at(table(boosters), word), F.lit(0.0)) * share
            turned = word.isin(list(negations)) | word.endswith("n't")
            v = F.when((i >= k) & F.get("_values", i - k).isNull(), moved * F.when(turned, S.NEGATION_FACTOR).otherwise(F.lit(1.0))).otherwise(v)
        return v

    listed = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_values", i).isNotNull())
    out = df.withColumn("_v", F.aggregate(F.transform(listed, valence), F.lit(0.0), lambda s, v: s + v))
    return out.withColumn("sentiment_score", F.round(F.col("_v") / F.sqrt(F.col("_v") * F.col("_v") + 15), 4)).drop("_v", "_words", "_values")
