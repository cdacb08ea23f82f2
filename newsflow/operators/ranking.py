"""Selections, top-k lists and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import is_noise_title, quality_reason
from .aggregates import _hours
from .windows import top_per_key


# --- filters -----------------------------------------------------------------------------------
def drop_noise_titles(news: DataFrame, **kw) -> DataFrame:
    return news.filter(~is_noise_title(F.col("title"), **kw))


def quality_gate(news: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    df = news.withColumn("reason", quality_reason(F.col("title"), F.col("snippet")))
    return df.filter("reason = 'ok'").drop("reason"), df.filter("reason <> 'ok'")


def recent(df: DataFrame, col: str, hours: float, as_of: Column, limit: int | None = None) -> DataFrame:
    out = df.filter(F.col(col) > as_of - _hours(hours)).orderBy(F.desc(col))
    return out.limit(limit) if limit else out


def by_status(news: DataFrame, status: str, limit: int = 50) -> DataFrame:
    return news.filter(F.col("status") == status).orderBy(F.desc("captured_at"), F.desc("news_id")).limit(limit)


def min_score(df: DataFrame, col: str, floor: float, order: str, limit: int = 50) -> DataFrame:
    return df.filter(F.col(col) >= floor).orderBy(F.desc(order)).limit(limit)


def by_type(df: DataFrame, col: str, value: str, order: str, limit: int = 50) -> DataFrame:
    return df.filter(F.col(col) == value).orderBy(F.desc(order)).limit(limit)


def active_mutes(preferences: DataFrame, as_of: Column, key: str = "muted_tickers", keep: tuple = ()) -> DataFrame:
    """(ticker, until) still muted, from the preference's JSON map; ``keep`` names further
    preference columns to carry along, such as the reader."""
    muted = (preferences.filter(F.col("key") == key)
             .select(*keep, F.explode(F.from_json("value", "map<string,string>")).alias("ticker", "u")))
    return (muted.select(*keep, "ticker", F.try_to_timestamp("u").alias("until"))
            .filter(F.col("until") > as_of))


def apply_mutes(news: DataFrame, mutes: DataFrame, id_col: str = "news_id") -> DataFrame:
    """Drop articles that name a muted ticker."""
    hit = (news.select(id_col, F.explode("tickers").alias("ticker"))
           .join(mutes.select("ticker"), "ticker", "left_semi").select(id_col).distinct())
    return news.join(hit, id_col, "left_anti")


# --- top-k -------------------------------------------------------------------------------------
def top_stories(news: DataFrame, k: int = 5) -> DataFrame:
    return news.filter("priority_score > 0").orderBy(F.desc("priority_score"), "news_id").limit(k)


def active_events(events: DataFrame, as_of: Column | None = None, min_sources: int = 2,
                  hours: float | None = None, order: str = "source_count", k: int | None = 5) -> DataFrame:
    df = events.filter(F.col("is_active") & (F.col("source_count") >= min_sources))
    if hours is not None:
        df = df.filter(F.col("last_updated") > as_of - _hours(hours))
    df = df.orderBy(F.desc(order), "event_id")
    return df.limit(k) if k else df


def movers(quotes: DataFrame, threshold: float, extreme: float = 0.07) -> DataFrame:
    size = F.abs("change_rate")
    return (quotes.filter(~F.col("name").contains("未知") & (size >= threshold))
            .withColumn("is_extreme", size >= extreme).orderBy(F.desc(size), "ticker"))


def alert_history(news: DataFrame, limit: int = 50) -> DataFrame:
    """Half newest fast, half newest deep pushes, merged newest first with a display level."""
    half = limit // 2
    both = by_status(news, "fast_pushed", half).unionByName(by_status(news, "deep_pushed", half))
    level = F.when(F.col("priority_score") >= 0.9, "critical").when(
        F.col("priority_score") >= 0.7, "important").otherwise("normal")
    return both.withColumn("level", level).orderBy(F.desc("captured_at"), F.desc("news_id")).limit(limit)


def cap_per_batch(alerts: DataFrame, batch: str = "batch", order: list | None = None, k: int = 4) -> DataFrame:
    """At most k chat alerts per cycle, in arrival order."""
    return top_per_key(alerts, [batch], order or ["ts", "id"], k)


# --- sets --------------------------------------------------------------------------------------
def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tracked_tickers(watch: DataFrame, portfolio: DataFrame) -> DataFrame:
    return (watch.select(F.upper("ticker").alias("ticker"))
            .union(portfolio.select(F.upper("ticker"))).distinct())


def merge_tags(a: Column, b: Column) -> Column:
    nothing = F.array().cast("array<string>")
    return F.array_remove(F.array_union(F.coalesce(a, nothing), F.coalesce(b, nothing)), "")


def tag_overlap(a: Column, b: Column, prefix: str = "STRATEGIC_") -> Column:
    def keep(c: Column) -> Column:
        return F.filter(c, lambda t: t.startswith(prefix))
    return F.size(F.array_intersect(keep(a), keep(b))) > 0


def only_within(tags: Column, allowed) -> Column:
    return (F.size(tags) > 0) & (F.size(F.array_except(tags, F.array(*[F.lit(x) for x in allowed]))) == 0)
