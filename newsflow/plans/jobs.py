"""The jobs a user runs: ingest, decide, capital flow, recalibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import dedup_key, mixed_tokens
from ..operators import aggregates as A
from ..operators import decisions as X
from ..operators import flow as L
from ..operators.cluster import cluster_events
from ..operators.dedup import dedup_batch
from ..operators.folds import suppress_topics
from ..operators.scoring import screen
from ..sinks.tables import alert_rows, append_new


def ingest(batch: DataFrame, news_path: str, seen: DataFrame | None = None,
           vectors: DataFrame | None = None) -> DataFrame:
    """New articles of a batch: all duplicate tiers, insert-or-ignore, event assignment."""
    fresh = dedup_batch(batch, seen, vectors)
    stored = append_new(fresh, news_path, "url", ["captured_at", "news_id"])
    return stored.join(cluster_events(stored), "news_id", "left")


def decide(screened: DataFrame, decisions: DataFrame, tracked=(), reviews: DataFrame | None = None) -> DataFrame:
    """Screened articles joined with their parsed verdicts to alert levels and review results."""
    df = X.apply_event_decision(screened.join(decisions, "news_id"), tracked)
    df = df.withColumn("alert_level", F.when(F.col("is_event"), F.col("alert_level")).otherwise("normal"))
    if reviews is None:
        return df.withColumn("reviewed_level", F.col("alert_level"))
    return X.apply_review(df.join(reviews.select("news_id", "failures"), "news_id", "left"))


def dispatch(decided: DataFrame, recipients: DataFrame) -> DataFrame:
    """Alert rows per recipient that pass the phone gate and topic suppression.

    ``recipients``: recipient, channel. The gate comes first, so a gated alert does not take the
    topic's slot.
    """
    rows = alert_rows(decided, "reviewed_level").join(recipients, "channel")
    tags = F.filter("macro_tags", lambda t: t.startswith("STRATEGIC_"))
    rows = (rows.withColumn("dedup_key", dedup_key(F.col("tickers"), F.col("headline_signal"), F.col("title"), F.col("direction")))
            .withColumn("tokens", mixed_tokens(F.coalesce(F.nullif("headline_signal", F.lit("")), "title")))
            .withColumn("strategic_tags", tags).withColumn("intensity", F.col("final_intensity"))
            .withColumn("ts", F.col("captured_at")).withColumn("id", F.col("news_id")))
    phone = rows.filter("channel = 'pushover'").filter(X.phone_gate(F.col("reviewed_level"), F.col("macro_tags"), F.col("impact_score")))
    chat = rows.filter("channel = 'telegram'")
    keep = ["id", "recipient", "channel", "silent", "reviewed_level", "ts", "dedup_key", "tokens", "strategic_tags", "intensity", "source", "published_at"]
    passed = suppress_topics(phone.select(*keep)).unionByName(suppress_topics(chat.select(*keep), 300, False))
    return passed.filter("passed").drop("tokens", "strategic_tags")


def flow_job(raw: DataFrame, klines: DataFrame, earnings: DataFrame) -> DataFrame:
    """Raw flows to push tiers; one shuffle by ticker carries the whole chain."""
    signals = L.divergence_signal(L.build_fund_flow(raw, klines))
    return L.flow_push_tier(L.earnings_silence(signals, earnings), "silenced")


def calibration(assess: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Both bias definitions per category, side by side."""
    return A.category_bias(assess, outcomes).join(
        A.ema_bias(assess, outcomes).select("category", F.col("bias").alias("ema_bias")), "category", "left")


def screen_batch(news: DataFrame, learned: DataFrame | None = None, **kw) -> DataFrame:
    """Screening with learned source weights (source, weight) where given."""
    if learned is None:
        return screen(news, **kw)
    w = learned.select(F.lower("source").alias("_s"), F.col("weight").alias("source_weight"))
    return screen(news.join(w, F.lower("source") == F.col("_s"), "left").drop("_s"), **kw)


def as_of_now() -> Column:
    return F.current_timestamp()
