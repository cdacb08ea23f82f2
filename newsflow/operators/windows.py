"""Window operators on feeds, prices and health records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import signal_words as S
from ..functions.text import count_found


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key. The rank filter is applied before the shuffle as well, so a key
    that holds most rows sends k rows per input partition, not all of them."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def last_n(fund_flow: DataFrame, n: int = 20, key: str = "ticker", date: str = "date") -> DataFrame:
    """Newest n days per ticker; sort ascending for display."""
    return top_per_key(fund_flow, [key], [F.desc(date)], n)


def latest_date(fund_flow: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    return fund_flow.groupBy(key).agg(F.max(date).alias("latest_date"))


def backfill_change_pct(fund_flow: DataFrame) -> DataFrame:
    """Change from the previous close where the reported change is 0.

    (ticker, date) is the unique key of the table, so a ticker's window holds at most one row
    per calendar day.
    """
    prev = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    change = F.try_divide(F.col("close") - prev, prev) * 100
    usable = (F.col("change_pct") == 0) & (F.col("close") != 0) & (prev != 0)
    return fund_flow.withColumn("change_pct", F.when(usable, change).otherwise(F.col("change_pct")))


def daily_bars(prices: DataFrame, symbol: str = "symbol", ts: str = "ts", close: str = "close",
               volume: str | None = None) -> DataFrame:
    """One bar per symbol and day: last price, summed volume. Pre-aggregates before any window."""
    cols = [F.max_by(close, ts).alias("close")]
    cols.append(F.sum(volume).alias("volume") if volume else F.count("*").alias("volume"))
    return prices.groupBy(symbol, F.to_date(ts).alias("date")).agg(*cols)


def market_enrichment(bars: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Latest price, change, 20/50-day means with side and volume ratio, one row per symbol.

    ``bars`` is a daily table (one row per symbol and day), see :func:`daily_bars`.
    """
    recent = top_per_key(bars, [symbol], [F.desc("date")], 50, rank="age")

    def mean(col: str, n: int) -> Column:
        inside = F.col("age") <= n
        return F.when(F.sum(inside.cast("int")) >= n, F.avg(F.when(inside, F.col(col))))

    price = F.round(F.max(F.when(F.col("age") == 1, F.col("close"))), 2)
    prev = F.coalesce(F.max(F.when(F.col("age") == 2, F.col("close"))), price)
    volume = F.max(F.when(F.col("age") == 1, F.col("volume")))
    out = recent.groupBy(symbol).agg(
        price.alias("price"), prev.alias("_prev"), volume.alias("volume"),
        F.round(mean("close", 20), 2).alias("ma20"), F.round(mean("close", 50), 2).alias("ma50"),
        mean("volume", 20).alias("_vol20"))
    pct = F.coalesce(F.round(F.try_divide(F.col("price") - F.col("_prev"), F.col("_prev")) * 100, 2), F.lit(0.0))

    def side(ma: str) -> Column:
        return F.when(F.col(ma).isNotNull(), F.when(F.col("price") > F.col(ma), "above").otherwise("below"))

    ratio = F.coalesce(F.round(F.try_divide(F.col("volume"), F.coalesce("_vol20", "volume")), 1), F.lit(1.0))
    return out.select(symbol, "price", pct.alias("change_pct"), "ma20", side("ma20").alias("vs_ma20"),
                      "ma50", side("ma50").alias("vs_ma50"), "volume", ratio.alias("volume_ratio"))


def novelty_rule(text: Column, is_breaking: Column, shock=S.SHOCK_WORDS, fresh=S.NOVELTY_WORDS) -> Column:
    """Novelty that the text alone decides; null if it depends on earlier texts."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    shocks, news_words = count_found(low, shock), count_found(low, fresh)
    return (F.when(t == "", 0.85).when(is_breaking, 1.0).when(shocks >= 2, 1.0).when(shocks == 1, 0.9)
            .when(news_words >= 2, 0.85))


def novelty(news: DataFrame, text: str = "text", id_col: str = "news_id", order: str = "captured_at",
            shock=S.SHOCK_WORDS, fresh=S.NOVELTY_WORDS, head_chars: int | None = None) -> DataFrame:
    """Novelty factor; a repeated text scores 0.1. ``head_chars`` (200 in the described system) compares heads only.

    Only texts that reach the repeat test are remembered, as in the rule order. First
    occurrences are found by an aggregate and flagged by id, so copies never meet in one task.
    ``novelty_rule`` is used where the column is there, as from one pass over the distinct texts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    ready = "novelty_rule" in news.columns
    rated = news.withColumn("_rule", F.col("novelty_rule") if ready else novelty_rule(F.col(text), F.col("is_breaking"), shock, fresh))
    firsts = (rated.filter("_rule is null")
              .groupBy(F.sha2(F.substring(t, 1, head_chars) if head_chars else t, 256).alias("h"))
              .agg(F.min(F.struct(order, id_col)).alias("f"))
              .select(F.col(f"f.{id_col}").alias(id_col), F.lit(True).alias("_first")))
    return (rated.join(firsts, id_col, "left")
            .withColumn("novelty", F.coalesce("_rule", F.when(F.col("_first"), 0.85).otherwise(0.1)))
            .drop("_rule", "_first"))


# --- streaks -----------------------------------------------------------------------------------
def _with_streaks(df: DataFrame, key: str, order: list[str], bad: str, chunk: str) -> DataFrame:
    """Consecutive count of ``bad`` rows up to each row.

    Windows run inside (key, chunk); what a chunk inherits comes from a one-row-per-chunk
    summary, so a key with very many rows is spread over its chunks.
    """
    w = Window.partitionBy(key, chunk).orderBy(*order)
    ok = (~F.col(bad)).cast("int")
    marked = df.withColumn("_island", F.sum(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, chunk, "_island").orderBy(*order)
    marked = marked.withColumn("_run", F.sum(F.col(bad).cast("int")).over(
        inner.rowsBetween(Window.unboundedPreceding, 0)))
    # bad rows after the last good one, per chunk
    pos = F.struct(*order)
    summary = df.groupBy(key, chunk).agg(
        F.max(F.when(~F.col(bad), pos)).alias("_last_ok"), F.count("*").alias("_n"))
    tail = (df.join(summary, [key, chunk])
            .groupBy(key, chunk).agg(F.sum(F.when(F.col("_last_ok").isNull() | (pos > F.col("_last_ok")), 1)
                                           .otherwise(0)).alias("_tail"),
                                     F.first(F.col("_last_ok").isNull()).alias("_all_bad")))
    by_chunk = Window.partitionBy(key).orderBy(chunk)
    segment = F.sum((~F.col("_all_bad")).cast("int")).over(by_chunk.rowsBetween(Window.unboundedPreceding, 0))
    seg = tail.withColumn("_seg", segment)
    before = Window.partitionBy(key, "_seg").orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0)
    carried = (seg.withColumn("_open", F.sum("_tail").over(before))
               .withColumn("_carry", F.coalesce(F.lag("_open").over(by_chunk), F.lit(0)))
               .select(key, chunk, "_carry"))
    return (marked.join(carried, [key, chunk])
            .withColumn("streak", F.when(F.col(bad), F.col("_run") + F.when(
                F.col("_island") == 0, F.col("_carry")).otherwise(0)).otherwise(F.lit(0)))
            .drop("_island", "_run", "_carry"))


def source_streaks(cycles: DataFrame, threshold: int = 3, source: str = "source", ts: str = "ts",
                   tie: str | None = None, failed: str = "failed") -> DataFrame:
    """Stall and recovery events per source: stall when an error streak reaches the threshold,
    recovery at the next healthy cycle. Day chunks keep long histories spread out."""
    order = [ts] + ([tie] if tie else [])
    base = df = cycles.withColumn("_day", F.to_date(ts))
    streaked = _with_streaks(df, source, order, failed, "_day")
    # a healthy row recovers when the row before it carried a streak at or over the threshold
    w = Window.partitionBy(source, "_day").orderBy(*order)
    ends = (streaked.groupBy(source, "_day").agg(F.max_by("streak", F.struct(*order)).alias("_end")))
    prev_end = (ends.withColumn("_prev", F.lag("_end").over(Window.partitionBy(source).orderBy("_day")))
                .select(source, "_day", "_prev"))
    prior = F.coalesce(F.lag("streak").over(w), F.col("_prev"), F.lit(0))
    out = streaked.join(prev_end, [source, "_day"]).withColumn("_before", prior)
    event = (F.when(F.col("streak") == threshold, "source_stall")
             .when(~F.col(failed) & (F.col("_before") >= threshold), "source_recovered"))
    return (out.withColumn("event_type", event).filter("event_type is not null")
            .select(*base.drop("_day").columns, "event_type", "streak"))


def active_stalls(health: DataFrame, tie: str | None = None) -> DataFrame:
    """Sources whose newest stall/recovered record is a stall; ``tie`` orders records of one time, and
    without it a stall wins over a recovery."""
    named = (health.filter(F.col("event_type").isin("source_stall", "source_recovered"))
             .withColumn("source", F.split("detail", ":")[0]).filter("source <> ''"))
    order = F.struct("created_at", tie or "event_type")
    return (named.groupBy("source").agg(F.max_by("event_type", order).alias("latest"))
            .filter("latest = 'source_stall'").select("source"))


def hours_since_last_push(news: DataFrame, as_of: Column, hours: int = 72,
                          ts: str = "captured_at") -> DataFrame:
    newest = F.max(F.when(F.col("status").contains("pushed")
                          & (F.col(ts) > as_of - F.make_interval(hours=F.lit(hours))), F.col(ts)))
    gap = (F.unix_micros(as_of) - F.unix_micros(newest)) / 3.6e9
    return news.agg(F.coalesce(F.round(gap, 1), F.lit(999.0)).alias("hours_since_push"))
