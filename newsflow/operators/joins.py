"""As-of, anti and patch joins on assessments, prices and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import checkpoint
from .aggregates import _hours

WINDOW_HOURS = {"15m": 0.25, "1h": 1.0, "4h": 4.0}


def pending_outcomes(assess: DataFrame, outcomes: DataFrame, window: str, as_of: Column) -> DataFrame:
    """Assessments old enough for the window that have no outcome for it yet."""
    done = outcomes.filter(F.col("window") == window).select(F.col("assessment_id").alias("id")).distinct()
    return assess.filter(F.col("created_at") <= as_of - _hours(WINDOW_HOURS[window])).join(done, "id", "left_anti")


def price_change_since(prices: DataFrame, anchors: DataFrame, symbol: str = "symbol", ts: str = "ts",
                       close: str = "close", anchor_id: str = "anchor_id", anchor_ts: str = "anchor_ts",
                       digits: int = 3) -> DataFrame:
    """Percent change from the first bar at or after each anchor to the latest bar.

    Bars and anchors are dealt together by ranges of (symbol, time), so a symbol with very many bars on one day
    lies in several chunks. The next bar of a later chunk and the symbol's first and last bar come from
    one-row-per-chunk summaries. An anchor after the last bar falls back to the first bar.
    """
    bars = prices.select(symbol, F.col(ts).alias("_ts"), F.col(close).cast("double").alias("_close"),
                         F.lit(None).cast(dict(anchors.dtypes)[anchor_id]).alias(anchor_id), F.lit(1).alias("_is_bar"))
    marks = anchors.select(symbol, F.col(anchor_ts).alias("_ts"), F.lit(None).cast("double").alias("_close"), anchor_id, F.lit(0).alias("_is_bar"))
    # chunks are numbered by time within a symbol; the checkpoint fixes them
    mixed = checkpoint(bars.unionByName(marks).repartitionByRange(symbol, "_ts").withColumn("_chunk", F.spark_partition_id()))
    bars, marks = mixed.filter("_is_bar = 1"), mixed.filter("_is_bar = 0")
    point = F.struct("_ts", "_close")
    chunks = bars.groupBy(symbol, "_chunk").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    ends = chunks.groupBy(symbol).agg(F.min("_first").alias("_open"), F.max("_last").alias("_end"))
    # first bar at or after the anchor inside its own chunk
    ahead = Window.partitionBy(symbol, "_chunk").orderBy(F.desc("_ts"), F.desc("_is_bar"), F.desc("_close"))
    same_chunk = (mixed.withColumn("_base", F.last("_close", ignorenulls=True).over(
        ahead.rowsBetween(Window.unboundedPreceding, 0))).filter("_is_bar = 0")
        .select(anchor_id, symbol, "_chunk", "_base"))
    # first bar of the next chunk that has any
    want = marks.select(symbol, "_chunk").distinct().withColumn("_n", F.lit(None).cast("double"))
    line = chunks.select(symbol, "_chunk", F.col("_first._close").alias("_n")).unionByName(want)
    later = Window.partitionBy(symbol).orderBy(F.desc("_chunk"))
    nxt = (line.groupBy(symbol, "_chunk").agg(F.max("_n").alias("_n"))
           .withColumn("_next", F.last("_n", ignorenulls=True).over(
               later.rowsBetween(Window.unboundedPreceding, -1))).select(symbol, "_chunk", "_next"))
    base = F.coalesce("_base", "_next", "_open._close")
    change = F.try_divide(F.col("_end._close") - base, base) * 100
    return (same_chunk.join(nxt, [symbol, "_chunk"], "left").join(ends, symbol)
            .select(anchor_id, symbol, base.alias("base"), F.col("_end._close").alias("last"),
                    F.round(change, digits).alias("change_pct")))


def daily_change_since(daily: DataFrame, anchors: DataFrame, symbol: str = "symbol", date: str = "date",
                       close: str = "close", anchor_id: str = "anchor_id", anchor_ts: str = "anchor_ts",
                       pad_days: int = 3) -> DataFrame:
    """Percent change from the first to the last daily close since anchor minus the padding;
    0 with fewer than two closes. ``daily`` has one row per symbol and day."""
    d = daily.filter(F.col(close).isNotNull()).select(symbol, F.col(date).alias("_d"), F.col(close).alias("_c"))
    ends = d.groupBy(symbol).agg(F.max_by("_c", "_d").alias("_end"), F.max("_d").alias("_end_d"))
    marks = anchors.select(anchor_id, symbol, F.date_sub(F.to_date(anchor_ts), pad_days).alias("_from"))
    asks = marks.select(symbol, F.col("_from").alias("_d")).distinct()
    # first close on or after each requested date, by a backward-looking window over days
    line = (d.select(symbol, "_d", "_c").unionByName(asks.select(symbol, "_d", F.lit(None).cast("double").alias("_c")))
            .groupBy(symbol, "_d").agg(F.max("_c").alias("_c")))
    later = Window.partitionBy(symbol).orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, 0)
    first = line.select(symbol, F.col("_d").alias("_from"),
                        F.last("_c", ignorenulls=True).over(later).alias("_start"),
                        F.last(F.when(F.col("_c").isNotNull(), F.col("_d")), ignorenulls=True).over(later).alias("_start_d"))
    enough = F.col("_start_d") < F.col("_end_d")
    change = F.round(F.try_divide(F.col("_end") - F.col("_start"), F.col("_start")) * 100, 2)
    return (marks.join(first, [symbol, "_from"], "left").join(ends, symbol, "left")
            .select(anchor_id, symbol, F.coalesce(F.when(enough, change), F.lit(0.0)).alias("change_pct")))
