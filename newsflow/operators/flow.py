"""Capital-flow signals over the daily fund_flow table (unique per ticker and date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import top_per_key

TIERS = ["super_net", "big_net", "mid_net", "small_net"]


def build_fund_flow(raw: DataFrame, klines: DataFrame, days: int | None = None) -> DataFrame:
    """Raw tier flows plus prices to the fund_flow shape."""
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in [*TIERS, "main_in_flow"]}
    flows = raw.select("ticker", "date", *[v.alias(k) for k, v in zero.items()])
    gross = sum((F.abs(c) for c in TIERS[1:]), F.abs(TIERS[0]))
    main = F.when(F.col("main_in_flow") != 0, F.col("main_in_flow")).otherwise(
        F.col("super_net") + F.col("big_net"))
    out = (flows.withColumn("main_net", main)
           .withColumn("main_pct", F.when(gross > 0, F.round(F.col("main_net") / gross * 100, 2))
                       .otherwise(F.lit(0.0)))
           .join(klines.select("ticker", "date", "close", "change_pct"), ["ticker", "date"], "left")
           .fillna(0.0, ["close", "change_pct"]))
    return top_per_key(out, ["ticker"], [F.desc("date")], days) if days else out


def _day(col: str, n: int) -> Column:
    """Value of the n-th newest day inside a per-ticker aggregate."""
    return F.max(F.when(F.col("age") == n, F.col(col)))


def divergence_signal(fund_flow: DataFrame) -> DataFrame:
    """Price against super-order flow over the last three days, one row per ticker.

    Tickers with fewer than three days give no row. One shuffle by ticker: the last-three
    filter is applied on both sides of it and the aggregate reuses the partitioning.
    """
    last3 = top_per_key(fund_flow, ["ticker"], [F.desc("date")], 3, rank="age")
    cols = [F.count("*").alias("days"), F.max("date").alias("date"),
            F.sum("main_net").alias("cum_main"), F.sum("super_net").alias("cum_super"),
            F.sum("big_net").alias("cum_big"), F.sum("mid_net").alias("cum_mid"),
            F.sum("small_net").alias("cum_small"),
            F.sum(sum((F.abs(c) for c in TIERS[1:]), F.abs(TIERS[0]))).alias("gross"),
            F.sum(F.signum("super_net")).cast("int").alias("super_sign"),
            _day("main_pct", 1).alias("main_pct")]
    for n in (1, 2, 3):
        cols += [_day("close", n).alias(f"c{n}"), _day("change_pct", n).alias(f"r{n}"),
                 _day("super_net", n).alias(f"s{n}")]
    d = last3.groupBy("ticker").agg(*cols).filter("days = 3")

    def filled(n: int) -> Column:  # change of day n, from closes when it was not reported
        now, before = F.col(f"c{n}"), F.col(f"c{n + 1}")
        return F.when((F.col(f"r{n}") == 0) & (now != 0) & (before != 0),
                      (now - before) / before * 100).otherwise(F.col(f"r{n}"))

    d = d.withColumn("p1", filled(1)).withColumn("p2", filled(2)).withColumn("p3", F.col("r3"))
    first_close = F.when(F.col("c3") != 0, F.col("c3")).when(F.col("c2") != 0, F.col("c2"))
    last_close = F.when(F.col("c1") != 0, F.col("c1")).when(F.col("c2") != 0, F.col("c2"))
    closes = sum(((F.col(f"c{n}") != 0).cast("int") for n in (2, 3)), (F.col("c1") != 0).cast("int"))
    cum_price = F.when(closes >= 2, (last_close - first_close) / first_close * 100).otherwise(
        F.col("p1") + F.col("p2") + F.col("p3"))
    up1, up2 = F.signum(F.col("p1") - F.col("p2")), F.signum(F.col("p2") - F.col("p3"))
    fl1, fl2 = F.signum(F.col("s1") - F.col("s2")), F.signum(F.col("s2") - F.col("s3"))
    d = (d.withColumn("cum_price", cum_price)
         .withColumn("price_dir", (up1 + up2).cast("int")).withColumn("flow_dir", (fl1 + fl2).cast("int"))
         .withColumn("divergent", (up1 * fl1 < 0).cast("int") + (up2 * fl2 < 0).cast("int")))
    c = F.col
    sums = ["cum_super", "cum_big", "cum_mid", "cum_small"]
    all_up = F.least(*sums) > 0
    all_down = F.greatest(*sums) < 0
    trap = ((c("cum_price") > 5) & (c("cum_super") <= 0)
            & (c("cum_small") > F.greatest(F.abs("cum_super") * 3, c("gross") * 0.01)))
    pit = (c("cum_price") < -10) & (c("cum_super") > 0) & (c("gross") < F.abs("cum_super") * 5)
    d = d.withColumn("retail_trap", trap).withColumn("golden_pit", pit)
    two = c("divergent") >= 2
    bullish = two & (c("price_dir") < 0) & (c("flow_dir") > 0)
    bearish = two & (c("price_dir") > 0) & (c("flow_dir") < 0)
    base = F.least(c("divergent") * 35, F.lit(100))
    retail_in = (c("cum_small") > 0) & (c("cum_mid") > 0) & (c("cum_super") <= 0)
    retail_out = (c("cum_small") < 0) & (c("cum_mid") < 0) & (c("cum_super") >= 0)
    same = (c("price_dir") != 0) & (c("price_dir") == c("flow_dir"))
    aligned = (all_up & (c("cum_price") > 0)) | (all_down & (c("cum_price") < 0))
    rules = [  # condition, signal, strength, modifier
        (bullish & pit, "bullish_divergence", F.least(base + 20, F.lit(100)), "golden_pit"),
        (bullish, "bullish_divergence", base, None),
        (bearish & trap, "bearish_divergence", base + 20, "retail_trap"),
        (bearish, "bearish_divergence", base, None),
        (two, "divergence", base, None),
        ((c("divergent") == 1) & pit, "warning", F.lit(45), "golden_pit_partial"),
        (c("divergent") == 1, "warning", F.lit(30), None),
        (aligned & all_up, "confirmation", F.lit(75), "all_tiers_aligned_up"),
        (aligned, "confirmation", F.lit(75), "all_tiers_aligned_down"),
        (retail_in, "warning", F.lit(40), "retail_only"),
        (retail_out, "warning", F.lit(35), "retail_panic"),
        (same, "confirmation", F.lit(60), None),
    ]
    pick = None
    for cond, signal, strength, modifier in rules:
        value = F.struct(F.lit(signal).alias("signal"), strength.cast("int").alias("strength"),
                         F.lit(modifier).cast("string").alias("modifier"))
        pick = F.when(cond, value) if pick is None else pick.when(cond, value)
    pick = pick.otherwise(F.struct(F.lit("none").alias("signal"), F.lit(0).alias("strength"),
                                   F.lit(None).cast("string").alias("modifier")))
    d = d.withColumn("pick", pick)
    bull, bear = c("pick.signal") == "bullish_divergence", c("pick.signal") == "bearish_divergence"
    against = (bull & (c("cum_small") < 0)) | (bear & (c("cum_small") > 0))
    along = (bull & (c("cum_small") > 0)) | (bear & (c("cum_small") < 0))
    strength = (F.when(against, F.least(c("pick.strength") + 15, F.lit(100)))
                .when(along, F.greatest(c("pick.strength") - 15, F.lit(0))).otherwise(c("pick.strength")))
    second = F.when(against, "small_reverse_confirm").when(along, "small_same_downgrade")
    return d.select(
        "ticker", "date", c("pick.signal").alias("signal"), strength.alias("strength"),
        F.when(strength >= 85, "STRONG").when(strength >= 40, "STANDARD").otherwise("WEAK")
        .alias("final_strength"),
        continuity(c("super_sign")).alias("continuity"), participation(c("main_pct")).alias("participation"),
        "cum_main", "cum_super", "cum_small", "cum_price", "main_pct",
        (all_up | all_down).alias("all_tiers_aligned"), "retail_trap", "golden_pit",
        F.array_compact(F.array(c("pick.modifier"), second)).alias("modifiers"))


def continuity(sign_sum: Column) -> Column:
    return (F.when(sign_sum >= 2, "continuous_inflow").when(sign_sum <= -2, "continuous_outflow")
            .otherwise("mixed"))


def participation(main_pct: Column) -> Column:
    size = F.abs(main_pct)
    return F.when(size > 15, "extreme").when(size > 8, "strong").when(size > 3, "normal").otherwise("low")


def flow_participation(fund_flow: DataFrame) -> DataFrame:
    """Continuity of super flow and participation of the latest day."""
    last3 = top_per_key(fund_flow, ["ticker"], [F.desc("date")], 3, rank="age")
    d = last3.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.signum("super_net")).alias("s"),
                                    _day("main_pct", 1).alias("main_pct")).filter("n = 3")
    return d.select("ticker", continuity(F.col("s")).alias("continuity"),
                    participation(F.col("main_pct")).alias("participation"), "main_pct")


def flow_participation_v1(fund_flow: DataFrame) -> DataFrame:
    """Older variant on the main flow: zero counts as outflow, all three days must agree."""
    last3 = top_per_key(fund_flow, ["ticker"], [F.desc("date")], 3, rank="age")
    inflow = F.col("main_net") > 0
    d = last3.groupBy("ticker").agg(
        F.count("*").alias("n"), F.every(inflow).alias("all_in"), F.every(~inflow).alias("all_out"),
        F.sum("main_net").alias("cum_main"), F.sum("super_net").alias("cum_super"),
        _day("main_pct", 1).alias("main_pct")).filter("n = 3")
    size = F.abs("main_pct")
    band = F.when(size < 2, "low").when(size < 8, "normal").when(size < 15, "strong").otherwise("extreme")
    way = F.when(F.col("all_in"), "continuous_inflow").when(F.col("all_out"), "continuous_outflow").otherwise("mixed")
    return d.select("ticker", way.alias("continuity"), band.alias("participation"), "cum_main", "cum_super")


def flow_push_tier(signals: DataFrame, silenced: str | None = None) -> DataFrame:
    """Push tier 0 (skip), 1 (silent) or 2 (loud)."""
    strong = F.col("final_strength") == "STRONG"
    extreme = F.col("participation") == "extreme"
    diverges = F.col("signal").isin("bearish_divergence", "bullish_divergence")
    tier = (F.when(diverges & strong & extreme, 2).when(diverges & strong, 1)
            .when((F.col("signal") == "confirmation") & strong & extreme, 1).otherwise(0))
    tier = F.least(tier + F.col("golden_pit").cast("int") + F.col("retail_trap").cast("int"), F.lit(2))
    if silenced:
        tier = F.when(F.col(silenced), 0).otherwise(tier)
    return signals.withColumn("push_tier", tier)


def earnings_silence(signals: DataFrame, earnings: DataFrame, days: int = 5,
                     as_of: str = "date") -> DataFrame:
    """Silence a ticker whose latest past earnings date is at most ``days`` days back.

    "Latest past date within the window" is "any date in the window", so a semi join suffices.
    """
    e = earnings.select(F.col("ticker").alias("_t"), F.col("earnings_date").alias("_e")).distinct()
    recent = (signals.select("ticker", as_of).distinct()
              .join(e, (F.col("ticker") == F.col("_t"))
                    & F.datediff(F.col(as_of), F.col("_e")).between(0, days), "left_semi")
              .withColumn("silenced", F.lit(True)))
    return (signals.join(recent, ["ticker", as_of], "left")
            .withColumn("silenced", F.coalesce("silenced", F.lit(False))))


# --- sectors -----------------------------------------------------------------------------------
def plate_constituents(stocks: DataFrame, flow: DataFrame, k: int = 10, sector: str = "sector") -> DataFrame:
    """Flow rows of the first k stocks (by listed position) of each sector."""
    first = top_per_key(stocks, [sector], ["position"], k).select(sector, "ticker")
    return first.join(flow, "ticker")


def sector_flow(constituents: DataFrame, days: int = 3, sector: str = "sector", leaders: int = 5) -> DataFrame:
    """Sums of the last days per sector and its leading tickers by absolute main flow."""
    recent = top_per_key(constituents, [sector, "ticker"], [F.desc("date")], days)
    per_ticker = recent.groupBy(sector, "ticker").agg(
        F.sum("super_net").alias("super_net"),
        F.sum(F.col("super_net") + F.col("big_net")).alias("main_net"),
        F.sum("total_net").alias("total_net"))
    sums = per_ticker.groupBy(sector).agg(F.sum("super_net").alias("super_net"),
                                          F.sum("main_net").alias("main_net"),
                                          F.sum("total_net").alias("total_net"))
    top = top_per_key(per_ticker, [sector], [F.desc(F.abs("main_net")), "ticker"], leaders, rank="pos")
    lead = top.groupBy(sector).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "ticker"))), lambda s: s["ticker"]).alias("leading_tickers"))
    return sums.join(lead, sector)


def rank_sectors(flow: DataFrame, k: int = 5, sector: str = "sector") -> DataFrame:
    """Top k and bottom k sectors by main flow; a sector is never on both sides."""
    cols = flow.select(sector, "main_net")

    def end(order: list, side: str) -> DataFrame:
        few = cols.orderBy(*order).limit(k)
        pos = F.row_number().over(Window.orderBy(*order))
        return few.select(F.lit(side).alias("side"), pos.alias("pos"), sector, "main_net")

    top = end([F.desc("main_net"), F.asc(sector)], "top")
    bottom = end([F.asc("main_net"), F.desc(sector)], "bottom").join(top.select(sector), sector, "left_anti")
    return top.unionByName(bottom)
