"""Queries over capital flow, prices, assessments, feedback and health records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import views as V
from ..operators import aggregates as A
from ..operators import decisions as X
from ..operators import flow as L
from ..operators import folds as O
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import windows as W
from .registry import query
from .views import sql

AS_OF = f"TIMESTAMP '{V.AS_OF}'"
ORDERS_AS_OF = f"TIMESTAMP '{V.AS_OF_ORDERS}'"
LAST3 = "r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM v_flow), l AS (SELECT * FROM r WHERE age <= 3)"

SIGNAL = f"""{LAST3}, a AS (SELECT ticker, max(date) AS date, sum(main_net) AS cum_main, sum(super_net) AS cs, sum(big_net) AS cb, sum(mid_net) AS cm, sum(small_net) AS csm,
 sum(abs(super_net) + abs(big_net) + abs(mid_net) + abs(small_net)) AS gross, sum(sign(super_net)) AS ss, max(CASE WHEN age = 1 THEN main_pct END) AS main_pct,
 max(CASE WHEN age = 1 THEN close END) AS c1, max(CASE WHEN age = 2 THEN close END) AS c2, max(CASE WHEN age = 3 THEN close END) AS c3,
 max(CASE WHEN age = 1 THEN super_net END) AS s1, max(CASE WHEN age = 2 THEN super_net END) AS s2, max(CASE WHEN age = 3 THEN super_net END) AS s3
 FROM l GROUP BY ticker HAVING count(*) = 3),
 p AS (SELECT *, (c1 - c2) / c2 * 100 AS p1, (c2 - c3) / c3 * 100 AS p2, 0.0 AS p3, (c1 - c3) / c3 * 100 AS cum_price FROM a),
 q AS (SELECT *, sign(p1 - p2) + sign(p2 - p3) AS pd, sign(s1 - s2) + sign(s2 - s3) AS fd,
 CASE WHEN sign(p1 - p2) * sign(s1 - s2) < 0 THEN 1 ELSE 0 END + CASE WHEN sign(p2 - p3) * sign(s2 - s3) < 0 THEN 1 ELSE 0 END AS dv,
 cs > 0 AND cb > 0 AND cm > 0 AND csm > 0 AS up4, cs < 0 AND cb < 0 AND cm < 0 AND csm < 0 AS down4,
 cum_price > 5 AND cs <= 0 AND csm > greatest(abs(cs) * 3, gross * 0.01) AS trap, cum_price < -10 AND cs > 0 AND gross < abs(cs) * 5 AS pit FROM p),
 g AS (SELECT *, CASE WHEN dv >= 2 AND pd < 0 AND fd > 0 THEN 'bullish_divergence' WHEN dv >= 2 AND pd > 0 AND fd < 0 THEN 'bearish_divergence'
 WHEN dv >= 2 THEN 'divergence' WHEN dv = 1 THEN 'warning' WHEN up4 AND cum_price > 0 OR down4 AND cum_price < 0 THEN 'confirmation'
 WHEN csm > 0 AND cm > 0 AND cs <= 0 THEN 'warning' WHEN csm < 0 AND cm < 0 AND cs >= 0 THEN 'warning'
 WHEN pd <> 0 AND pd = fd THEN 'confirmation' ELSE 'none' END AS signal,
 CASE WHEN dv >= 2 AND pd < 0 AND fd > 0 THEN CASE WHEN pit THEN 90 ELSE 70 END WHEN dv >= 2 AND pd > 0 AND fd < 0 THEN CASE WHEN trap THEN 90 ELSE 70 END
 WHEN dv >= 2 THEN 70 WHEN dv = 1 THEN CASE WHEN pit THEN 45 ELSE 30 END WHEN up4 AND cum_price > 0 OR down4 AND cum_price < 0 THEN 75
 WHEN csm > 0 AND cm > 0 AND cs <= 0 THEN 40 WHEN csm < 0 AND cm < 0 AND cs >= 0 THEN 35 WHEN pd <> 0 AND pd = fd THEN 60 ELSE 0 END AS base FROM q),
 h AS (SELECT *, CASE WHEN signal = 'bullish_divergence' AND csm < 0 OR signal = 'bearish_divergence' AND csm > 0 THEN least(base + 15, 100)
 WHEN signal = 'bullish_divergence' AND csm > 0 OR signal = 'bearish_divergence' AND csm < 0 THEN greatest(base - 15, 0) ELSE base END AS strength FROM g),
 sig AS (SELECT ticker, date, signal, strength, CASE WHEN strength >= 85 THEN 'STRONG' WHEN strength >= 40 THEN 'STANDARD' ELSE 'WEAK' END AS final_strength,
 CASE WHEN ss >= 2 THEN 'continuous_inflow' WHEN ss <= -2 THEN 'continuous_outflow' ELSE 'mixed' END AS continuity,
 CASE WHEN abs(main_pct) > 15 THEN 'extreme' WHEN abs(main_pct) > 8 THEN 'strong' WHEN abs(main_pct) > 3 THEN 'normal' ELSE 'low' END AS participation,
 cum_main, cs AS cum_super, csm AS cum_small, round(cum_price, 4) AS cum_price, main_pct, up4 OR down4 AS all_tiers_aligned, trap AS retail_trap, pit AS golden_pit FROM h)"""


@query(sql(f"WITH {SIGNAL} SELECT * FROM sig", "v_flow"))
def divergence_signal(spark: SparkSession, d: str) -> DataFrame:
    return L.divergence_signal(V.fund_flow(spark, d)).drop("modifiers").withColumn("cum_price", F.round("cum_price", 4))


TIER = """least(CASE WHEN signal IN ('bullish_divergence', 'bearish_divergence') AND final_strength = 'STRONG' AND participation = 'extreme' THEN 2
 WHEN signal IN ('bullish_divergence', 'bearish_divergence') AND final_strength = 'STRONG' THEN 1
 WHEN signal = 'confirmation' AND final_strength = 'STRONG' AND participation = 'extreme' THEN 1 ELSE 0 END + golden_pit::INT + retail_trap::INT, 2)"""


@query(sql(f"""WITH {SIGNAL} SELECT ticker, signal, silenced, CASE WHEN silenced THEN 0 ELSE {TIER} END AS push_tier FROM (
 SELECT *, EXISTS (SELECT 1 FROM supplier s WHERE CAST(s_suppkey AS VARCHAR) = ticker AND date_diff('day', sig.date - CAST(s_suppkey % 9 AS INT), sig.date) BETWEEN 0 AND 5) AS silenced FROM sig)""", "v_flow"))
def flow_push_tier(spark: SparkSession, d: str) -> DataFrame:
    """Signals, silenced where a (given) earnings date is at most five days back."""
    s = L.divergence_signal(V.fund_flow(spark, d))
    sup = V.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), (F.col("s_suppkey") % 9).cast("int").alias("off"))
    earnings = s.select("ticker", "date").join(sup, "ticker").select("ticker", F.date_sub("date", F.col("off")).alias("earnings_date"))
    return L.flow_push_tier(L.earnings_silence(s, earnings), "silenced").select("ticker", "signal", "silenced", "push_tier")


@query(sql(f"""WITH {LAST3} SELECT ticker, CASE WHEN sum(sign(super_net)) >= 2 THEN 'continuous_inflow' WHEN sum(sign(super_net)) <= -2 THEN 'continuous_outflow' ELSE 'mixed' END AS continuity,
 CASE WHEN abs(max(CASE WHEN age = 1 THEN main_pct END)) > 15 THEN 'extreme' WHEN abs(max(CASE WHEN age = 1 THEN main_pct END)) > 8 THEN 'strong'
 WHEN abs(max(CASE WHEN age = 1 THEN main_pct END)) > 3 THEN 'normal' ELSE 'low' END AS participation, max(CASE WHEN age = 1 THEN main_pct END) AS main_pct
 FROM l GROUP BY ticker HAVING count(*) = 3""", "v_flow"))
def flow_participation(spark: SparkSession, d: str) -> DataFrame:
    return L.flow_participation(V.fund_flow(spark, d))


@query(sql(f"""WITH {LAST3} SELECT ticker, CASE WHEN min(main_net) > 0 THEN 'continuous_inflow' WHEN max(main_net) <= 0 THEN 'continuous_outflow' ELSE 'mixed' END AS continuity,
 CASE WHEN abs(max(CASE WHEN age = 1 THEN main_pct END)) < 2 THEN 'low' WHEN abs(max(CASE WHEN age = 1 THEN main_pct END)) < 8 THEN 'normal'
 WHEN abs(max(CASE WHEN age = 1 THEN main_pct END)) < 15 THEN 'strong' ELSE 'extreme' END AS participation, sum(main_net) AS cum_main, sum(super_net) AS cum_super
 FROM l GROUP BY ticker HAVING count(*) = 3""", "v_flow"))
def flow_participation_v1(spark: SparkSession, d: str) -> DataFrame:
    return L.flow_participation_v1(V.fund_flow(spark, d))


@query(sql("SELECT ticker, date, close, round(coalesce((close - p) / nullif(p, 0) * 100, 0), 4) AS change_pct FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM v_flow)", "v_flow"))
def change_backfill(spark: SparkSession, d: str) -> DataFrame:
    return W.backfill_change_pct(V.fund_flow(spark, d)).select("ticker", "date", "close", F.round("change_pct", 4).alias("change_pct"))


@query(sql("SELECT ticker, date, main_net, main_pct FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM v_flow) WHERE rn <= 20", "v_flow"))
def flow_last_days(spark: SparkSession, d: str) -> DataFrame:
    return W.last_n(V.fund_flow(spark, d), 20).select("ticker", "date", "main_net", "main_pct")


@query(sql("SELECT ticker, max(date) AS latest_date FROM v_flow GROUP BY ticker", "v_flow"))
def flow_latest_date(spark: SparkSession, d: str) -> DataFrame:
    return W.latest_date(V.fund_flow(spark, d))


@query(sql("""SELECT ticker, date, main_net, main_pct, close FROM (SELECT f.ticker, f.date,
 f.super_net + f.big_net AS main_net, CASE WHEN g > 0 THEN round((f.super_net + f.big_net) / g * 100, 2) ELSE 0 END AS main_pct, coalesce(k.close, 0) AS close,
 row_number() OVER (PARTITION BY f.ticker ORDER BY f.date DESC) AS rn
 FROM (SELECT *, abs(super_net) + abs(big_net) + abs(mid_net) + abs(small_net) AS g FROM v_flow) f
 LEFT JOIN (SELECT * FROM v_flow WHERE month(date) <> 6) k ON k.ticker = f.ticker AND k.date = f.date) WHERE rn <= 10""", "v_flow"))
def fund_flow_build(spark: SparkSession, d: str) -> DataFrame:
    f = V.fund_flow(spark, d)
    out = L.build_fund_flow(f, f.filter(F.month("date") != 6), 10)
    return out.select("ticker", "date", "main_net", "main_pct", "close")


SECTOR = """f10 AS (SELECT sector, ticker FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY position) AS rn FROM v_stocks) WHERE rn <= 10),
 c AS (SELECT f10.sector, f.*, f.super_net + f.big_net + f.mid_net + f.small_net AS total_net FROM f10 JOIN v_flow f USING (ticker)),
 l3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sector, ticker ORDER BY date DESC) AS rn FROM c) WHERE rn <= 3),
 pt AS (SELECT sector, ticker, sum(super_net) AS super_net, sum(super_net + big_net) AS main_net, sum(total_net) AS total_net FROM l3 GROUP BY 1, 2),
 sf AS (SELECT sector, sum(super_net) AS super_net, sum(main_net) AS main_net, sum(total_net) AS total_net FROM pt GROUP BY sector)"""


def _constituents(spark: SparkSession, d: str) -> DataFrame:
    f = V.fund_flow(spark, d).withColumn("total_net", F.col("super_net") + F.col("big_net") + F.col("mid_net") + F.col("small_net"))
    return L.plate_constituents(V.sector_stocks(spark, d), f)


@query(sql(f"""WITH {SECTOR}, t AS (SELECT sector, string_agg(ticker, ',' ORDER BY rk) AS leaders FROM (
 SELECT *, row_number() OVER (PARTITION BY sector ORDER BY abs(main_net) DESC, ticker) AS rk FROM pt) WHERE rk <= 5 GROUP BY sector)
 SELECT sf.sector, super_net, main_net, total_net, leaders FROM sf JOIN t ON t.sector = sf.sector""", "v_stocks", "v_flow"))
def sector_flow(spark: SparkSession, d: str) -> DataFrame:
    s = L.sector_flow(_constituents(spark, d))
    return s.select("sector", "super_net", "main_net", "total_net", F.array_join("leading_tickers", ",").alias("leaders"))


@query(sql(f"""WITH {SECTOR}, r AS (SELECT sector, main_net, row_number() OVER (ORDER BY main_net DESC, sector) AS a, row_number() OVER (ORDER BY main_net, sector DESC) AS b FROM sf)
 SELECT 'top' AS side, a AS pos, sector, main_net FROM r WHERE a <= 5 UNION ALL SELECT 'bottom', b, sector, main_net FROM r WHERE b <= 5 AND a > 5""", "v_stocks", "v_flow"))
def sector_rank(spark: SparkSession, d: str) -> DataFrame:
    return L.rank_sectors(L.sector_flow(_constituents(spark, d)))


# --- prices -------------------------------------------------------------------------------------
BARS = "b AS (SELECT symbol, CAST(ts AS DATE) AS date, arg_max(close, ts) AS close, count(*) AS volume FROM v_prices GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age FROM b)"


@query(sql(f"""WITH {BARS}, m AS (SELECT symbol, round(max(CASE WHEN age = 1 THEN close END), 2) AS price, max(CASE WHEN age = 2 THEN close END) AS prev, max(CASE WHEN age = 1 THEN volume END) AS volume,
 CASE WHEN count(*) >= 20 THEN round(avg(CASE WHEN age <= 20 THEN close END), 2) END AS ma20, CASE WHEN count(*) >= 20 THEN avg(CASE WHEN age <= 20 THEN volume END) END AS v20,
 CASE WHEN count(*) >= 50 THEN round(avg(CASE WHEN age <= 50 THEN close END), 2) END AS ma50 FROM n GROUP BY symbol)
 SELECT symbol, price, round((price - prev) / prev * 100, 2) AS change_pct, ma20, CASE WHEN price > ma20 THEN 'above' ELSE 'below' END AS vs_ma20, ma50,
 CASE WHEN ma50 IS NULL THEN NULL WHEN price > ma50 THEN 'above' ELSE 'below' END AS vs_ma50, volume, round(volume / v20, 1) AS volume_ratio FROM m""", "v_prices"))
def market_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return W.market_enrichment(W.daily_bars(V.prices(spark, d)))


@query(sql("""WITH a AS (SELECT o_orderkey AS anchor_id, (['click', 'view', 'error'])[o_orderkey % 3 + 1] AS symbol, TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 31) DAY + INTERVAL (o_orderkey % 1440) MINUTE AS ts FROM orders),
 e AS (SELECT symbol, arg_max(close, ts) AS last, arg_min(close, ts) AS open FROM v_prices GROUP BY symbol),
 f AS (SELECT a.anchor_id, a.symbol, p.close AS base FROM a ASOF LEFT JOIN v_prices p ON p.symbol = a.symbol AND p.ts >= a.ts)
 SELECT f.anchor_id, f.symbol, coalesce(f.base, e.open) AS base, e.last, round((e.last - coalesce(f.base, e.open)) / coalesce(f.base, e.open) * 100, 3) AS change_pct FROM f JOIN e USING (symbol)""", "v_prices"))
def asof_change(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    anchors = V.read(spark, d, "orders").select(
        k.alias("anchor_id"), F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("error")), (k % 3 + 1).cast("int")).alias("symbol"),
        F.timestamp_seconds(F.lit(1704067200) + (k % 31) * 86400 + (k % 1440) * 60).alias("anchor_ts"))
    return J.price_change_since(V.prices(spark, d), anchors)


@query(sql("""WITH b AS (SELECT ticker AS symbol, date, close FROM v_flow), a AS (SELECT o_orderkey AS anchor_id, CAST(o_custkey % 50 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) - 3 AS f FROM orders),
 e AS (SELECT symbol, arg_max(close, date) AS c, max(date) AS m FROM b GROUP BY symbol),
 s AS (SELECT a.anchor_id, a.symbol, b.close AS c, b.date AS m FROM a ASOF LEFT JOIN b ON b.symbol = a.symbol AND b.date >= a.f)
 SELECT s.anchor_id, s.symbol, coalesce(CASE WHEN s.m < e.m THEN round((e.c - s.c) / nullif(s.c, 0) * 100, 2) END, 0) AS change_pct FROM s LEFT JOIN e USING (symbol)""", "v_flow"))
def daily_change(spark: SparkSession, d: str) -> DataFrame:
    bars = V.fund_flow(spark, d).select(F.col("ticker").alias("symbol"), "date", "close")
    anchors = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("anchor_id"), (F.col("o_custkey") % 50).cast("string").alias("symbol"),
                                                F.col("o_orderdate").cast("timestamp").alias("anchor_ts"))
    return J.daily_change_since(bars, anchors)


@query(sql("""SELECT ticker, round(change_rate, 4) AS change_rate, abs(change_rate) >= 0.07 AS is_extreme FROM (
 SELECT ticker, (c1 - c2) / c2 AS change_rate FROM (SELECT ticker, max(CASE WHEN age = 1 THEN close END) AS c1, max(CASE WHEN age = 2 THEN close END) AS c2
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM v_flow) WHERE age <= 2 GROUP BY ticker)) WHERE abs(change_rate) >= 0.02""", "v_flow"))
def movers(spark: SparkSession, d: str) -> DataFrame:
    two = W.top_per_key(V.fund_flow(spark, d), ["ticker"], [F.desc("date")], 2, rank="age")
    q = two.groupBy("ticker").agg(F.max(F.when(F.col("age") == 1, F.col("close"))).alias("last"), F.max(F.when(F.col("age") == 2, F.col("close"))).alias("prev"))
    quotes = q.select("ticker", F.lit("n").alias("name"), ((F.col("last") - F.col("prev")) / F.col("prev")).alias("change_rate"))
    return R.movers(quotes, 0.02).select("ticker", F.round("change_rate", 4).alias("change_rate"), "is_extreme")


# --- assessments and outcomes -------------------------------------------------------------------
@query(sql(f"SELECT id, news_id, category FROM v_assess WHERE created_at <= {ORDERS_AS_OF} - INTERVAL 60 MINUTE AND id NOT IN (SELECT assessment_id FROM v_outcomes WHERE \"window\" = '1h')", "v_assess", "v_outcomes"))
def pending_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return J.pending_outcomes(V.assessments(spark, d), V.outcomes(spark, d), "1h", V.ts(V.AS_OF_ORDERS)).select("id", "news_id", "category")


@query(sql("""WITH m AS (SELECT assessment_id, max(actual_score) AS actual FROM v_outcomes GROUP BY 1) SELECT id, category, impact_score, actual, created_at FROM (
 SELECT a.*, m.actual, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id DESC) AS rn FROM v_assess a JOIN m ON m.assessment_id = a.id) WHERE rn <= 20""", "v_assess", "v_outcomes"))
def outcomes_by_category(spark: SparkSession, d: str) -> DataFrame:
    return A.outcomes_by_category(V.assessments(spark, d), V.outcomes(spark, d))


@query(sql("""WITH m AS (SELECT assessment_id, max(actual_score) AS actual FROM v_outcomes GROUP BY 1), r AS (
 SELECT a.*, m.actual, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id DESC) AS rn FROM v_assess a JOIN m ON m.assessment_id = a.id)
 SELECT category, count(*) AS samples, round(greatest(least(avg(impact_score - actual), 5), -5), 4) AS bias FROM r WHERE rn <= 20 GROUP BY category""", "v_assess", "v_outcomes"))
def category_bias(spark: SparkSession, d: str) -> DataFrame:
    return A.category_bias(V.assessments(spark, d), V.outcomes(spark, d)).select("category", "samples", "bias")


@query(sql("""WITH j AS (SELECT a.category, o.collected_at, a.id, o."window" AS w, CAST(round((a.impact_score - o.actual_score) * 100) AS BIGINT) AS e FROM v_assess a JOIN v_outcomes o ON o.assessment_id = a.id WHERE o.actual_score >= 0)
 SELECT category, list_reduce(list(e ORDER BY collected_at, id, w), lambda b, x: CAST(sign(b * 7 + x * 3) * ((abs(b * 7 + x * 3) + 5) // 10) AS BIGINT)) / 100.0 AS bias, count(*) AS samples FROM j GROUP BY category""", "v_assess", "v_outcomes"))
def ema_bias(spark: SparkSession, d: str) -> DataFrame:
    return A.ema_bias(V.assessments(spark, d), V.outcomes(spark, d))


@query(sql("SELECT version, round(avg(abs(impact_score - actual_score)), 2) AS mae, count(*) AS samples FROM v_assess JOIN v_outcomes ON assessment_id = id WHERE actual_score >= 0 GROUP BY version", "v_assess", "v_outcomes"))
def mae_by_version(spark: SparkSession, d: str) -> DataFrame:
    return A.mae_by_version(V.assessments(spark, d), V.outcomes(spark, d))


@query(sql("SELECT (SELECT count(*) FROM v_assess) AS total, (SELECT count(DISTINCT assessment_id) FROM v_outcomes) AS with_outcomes, (SELECT count(*) FROM v_assess) - (SELECT count(DISTINCT assessment_id) FROM v_outcomes) AS pending", "v_assess", "v_outcomes"))
def impact_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.impact_stats(V.assessments(spark, d), V.outcomes(spark, d))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least((least(abs(sqrt(l_extendedprice) % 7 - 3.5) / 3, 1) * 0.35 + least(l_tax * 200 / 15, 1) * 0.2
 + least(((l_discount * 20 > 0.5)::INT + (l_tax * 20 > 0.5)::INT) / 6, 1) * 0.2 + least((l_discount * 40 + l_tax * 40) / 2 / 8, 1) * 0.25) * 100
 * CASE l_linenumber % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 WHEN 3 THEN 0.45 ELSE 0.7 END, 100), 1) AS score FROM lineitem""")
def outcome_score(spark: SparkSession, d: str) -> DataFrame:
    li = V.read(spark, d, "lineitem")
    breadth = F.element_at(F.array(*[F.lit(b) for b in ("cross_asset", "broad_market", "sector", "single_stock", "other")]), F.col("l_linenumber") % 5 + 1)
    sectors = F.create_map(F.lit("XLK"), F.col("l_discount") * 20, F.lit("XLE"), F.col("l_tax") * 20)
    tickers = F.create_map(F.lit("A"), F.col("l_discount") * 40, F.lit("B"), F.col("l_tax") * 40)
    s = A.outcome_score(F.sqrt("l_extendedprice") % 7 - 3.5, F.col("l_tax") * 200, sectors, tickers, breadth)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("score"))


# --- feedback -----------------------------------------------------------------------------------
@query(sql(f"""WITH v AS (SELECT coalesce(nullif(n.source, ''), 'unknown') AS source, sum((reaction = 'thumbs_up')::INT) AS up, count(*) AS votes FROM v_feedback f JOIN v_news n ON n.news_id = f.news_id
 WHERE f.ts > {AS_OF} - INTERVAL 7 DAY AND reaction IN ('thumbs_up', 'thumbs_down') GROUP BY 1 HAVING count(*) >= 3)
 SELECT source, up, votes, round(CASE WHEN up / votes >= 0.8 THEN least(0.05 * 1.5, 0.15) WHEN up / votes <= 0.3 THEN greatest(0.05 * 0.7, 0.01)
 ELSE greatest(0.01, least(0.15, 0.05::DOUBLE + (up / votes - 0.5) * 0.05)) END, 4) AS weight FROM v""", "v_feedback", "v_news"))
def source_weights(spark: SparkSession, d: str) -> DataFrame:
    return A.source_weights(V.feedback(spark, d), V.news(spark, d), V.ts(V.AS_OF))


@query(sql(f"""SELECT topic, count(*) AS seen, sum((reaction IN ('thumbs_up', 'analyze'))::INT) AS engaged, round(sum((reaction IN ('thumbs_up', 'analyze'))::INT) / count(*), 4) AS weight FROM (
 SELECT f.reaction, unnest([n.lang, n.source]) AS topic FROM v_feedback f JOIN v_news n ON n.news_id = f.news_id WHERE f.ts > {AS_OF} - INTERVAL 14 DAY) GROUP BY topic HAVING count(*) >= 2""", "v_feedback", "v_news"))
def topic_weights(spark: SparkSession, d: str) -> DataFrame:
    n = V.news(spark, d).withColumn("macro_tags", F.array("lang", "source"))
    return A.topic_weights(V.feedback(spark, d), n, V.ts(V.AS_OF))


@query(sql(f"""WITH c AS (SELECT (SELECT count(*) FROM v_news WHERE status IN ('fast_pushed', 'deep_pushed') AND captured_at > {AS_OF} - INTERVAL 3 DAY) AS pushed, (SELECT count(*) FROM v_feedback WHERE ts > {AS_OF} - INTERVAL 3 DAY) AS engaged)
 SELECT pushed, engaged, round(engaged / pushed, 4) AS rate, CASE WHEN engaged / pushed >= 0.5 THEN 0.28 WHEN engaged / pushed <= 0.1 THEN 0.32 ELSE 0.3 END::DOUBLE AS threshold FROM c""", "v_news", "v_feedback"))
def push_threshold(spark: SparkSession, d: str) -> DataFrame:
    return A.push_threshold(V.feedback(spark, d), V.news(spark, d), V.ts(V.AS_OF))


@query(sql("""SELECT sum((reaction = 'thumbs_up')::INT) AS "right", sum((reaction = 'thumbs_down')::INT) AS wrong,
 round(sum((reaction = 'thumbs_up')::INT) * 100.0 / sum((reaction IN ('thumbs_up', 'thumbs_down'))::INT), 1)::DOUBLE AS accuracy_pct FROM v_feedback""", "v_feedback"))
def prediction_accuracy(spark: SparkSession, d: str) -> DataFrame:
    f = V.feedback(spark, d).replace({"thumbs_up": "prediction_right", "thumbs_down": "prediction_wrong"}, subset=["reaction"])
    return A.prediction_accuracy(f)


LABELS = """labels_ AS (SELECT priority_score, CASE WHEN reaction = 'thumbs_up' THEN true WHEN reaction IN ('thumbs_down', 'ignore') THEN false END AS should_push, 'feedback' AS origin FROM (
 SELECT n.priority_score, f.reaction FROM v_feedback f JOIN v_news n ON n.news_id = f.news_id ORDER BY f.ts DESC, f.news_id DESC LIMIT 500)
 UNION ALL SELECT priority_score, CASE WHEN actual >= 50 THEN true WHEN actual < 20 THEN false END, 'outcome' FROM (
 SELECT n.priority_score, o.actual FROM (SELECT assessment_id, max(actual_score) AS actual, max(collected_at) AS at FROM v_outcomes WHERE actual_score >= 0 GROUP BY 1) o
 JOIN v_assess a ON a.id = o.assessment_id JOIN v_news n ON n.news_id = a.news_id ORDER BY o.at DESC, o.assessment_id DESC LIMIT 500)),
 lab AS (SELECT * FROM labels_ WHERE should_push IS NOT NULL)"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return A.push_labels(V.feedback(spark, d), V.news(spark, d), V.assessments(spark, d), V.outcomes(spark, d))


@query(sql(f"WITH {LABELS} SELECT origin, should_push, count(*) AS n, round(avg(priority_score), 4)::DOUBLE AS mean_score FROM lab GROUP BY 1, 2", "v_feedback", "v_news", "v_outcomes", "v_assess"))
def push_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).groupBy("origin", "should_push").agg(F.count("*").alias("n"), F.round(F.avg("priority_score"), 4).alias("mean_score"))


@query(sql(f"""WITH {LABELS}, g AS (SELECT c.v / 100.0 AS critical, i.v / 100.0 AS important FROM (SELECT unnest([55, 60, 65, 70, 75, 80]) AS v) c, (SELECT unnest([35, 40, 45, 50, 55, 60]) AS v) i WHERE i.v < least(61, c.v)),
 m AS (SELECT critical, important, sum((priority_score >= important AND should_push)::INT) AS tp, sum((priority_score >= important AND NOT should_push)::INT) AS fp,
 sum((priority_score < important AND NOT should_push)::INT) AS tn, sum((priority_score < important AND should_push)::INT) AS fn FROM g, lab GROUP BY 1, 2)
 SELECT critical::DOUBLE AS critical, important::DOUBLE AS important, tp, fp, tn, fn, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall,
 round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3) AS f1 FROM m""", "v_feedback", "v_news", "v_outcomes", "v_assess"))
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return A.threshold_grid(_labels(spark, d))


@query(sql("""WITH r AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, news_id) - 1 AS i, count(*) OVER () AS n FROM v_news)
 SELECT p AS top_pct, priority_score::DOUBLE AS score, n FROM r, (SELECT unnest([90, 80, 70, 60, 50, 40, 30, 25, 20, 10]) AS p) WHERE i = least((n * p) // 100, n - 1)""", "v_news"))
def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.score_percentiles(V.news(spark, d))


@query(sql("""WITH r AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, news_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT * FROM v_news WHERE priority_score > 0 AND status <> 'pending' ORDER BY news_id DESC LIMIT 1000))
 SELECT news_id, priority_score::DOUBLE AS priority_score, i <= greatest(floor(n * 0.05), 1) AS should_push FROM r WHERE i <= greatest(floor(n * 0.05), 1) OR i >= floor(n * 0.8)""", "v_news"))
def bootstrap_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.bootstrap_labels(V.news(spark, d))


# --- evaluation ---------------------------------------------------------------------------------
SCORED = "SELECT id, category AS impact, impact_score / 100 AS composite, round(((id * 7) % 100) / 100.0, 2)::DOUBLE AS relevance, id % 4 + 1 AS impact_num, CASE WHEN id % 3 = 0 THEN 'gov_intervention' WHEN id % 3 = 1 THEN 'nvda_investment' END AS best_category FROM v_assess"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return V.assessments(spark, d).select(
        "id", F.col("category").alias("impact"), (F.col("impact_score") / 100).alias("composite"), F.round((k * 7) % 100 / 100, 2).alias("relevance"),
        (k % 4 + 1).alias("impact_num"), F.when(k % 3 == 0, "gov_intervention").when(k % 3 == 1, "nvda_investment").alias("best_category"))


@query(sql(f"SELECT impact, count(*) AS n, round(avg(composite), 4) AS avg, round(min(composite), 4) AS min, round(max(composite), 4) AS max FROM ({SCORED}) GROUP BY impact", "v_assess"))
def backtest_levels(spark: SparkSession, d: str) -> DataFrame:
    return A.level_stats(_scored(spark, d))


@query(sql(f"SELECT count(*) AS n, round(corr(impact_num, composite), 4) AS corr_composite, round(corr(impact_num, relevance), 4) AS corr_relevance, round(stddev_samp(relevance), 4) AS stdev_relevance, count(DISTINCT round(relevance, 2)) AS distinct_relevance FROM ({SCORED})", "v_assess"))
def backtest_report(spark: SparkSession, d: str) -> DataFrame:
    return A.backtest_report(_scored(spark, d))


@query(sql(f"SELECT best_category, count(*) AS n, round(avg(composite), 4) AS avg FROM ({SCORED}) WHERE best_category IS NOT NULL GROUP BY 1", "v_assess"))
def category_coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.category_coverage(_scored(spark, d))


@query(sql(f"SELECT impact, count(*) AS n, round(avg(composite), 4) AS avg, sum((composite >= 0.35)::INT) AS pushed, sum((composite >= 0.5)::INT) AS critical, round(sum((composite >= 0.35)::INT) / count(*) * 100, 1) AS push_pct FROM ({SCORED}) GROUP BY ROLLUP (impact)", "v_assess"))
def push_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.push_rate(_scored(spark, d))


@query(sql("""WITH t AS (SELECT o_orderkey AS case_id, o_orderkey % 5 + 1 AS intensity, o_orderkey % 2 = 0 AS is_push, list_filter(['T' || CAST(o_custkey % 7 AS VARCHAR), '9' || CAST(o_custkey % 3 AS VARCHAR)], lambda x: regexp_matches(x, '^[A-Z]')) AS tt,
 o_custkey % 5 + 1 AS pi, o_custkey % 2 = 0 AS pp, ['T' || CAST(o_orderkey % 7 AS VARCHAR)] AS pt FROM orders)
 SELECT count(*) AS n, sum((pi = intensity)::INT) AS exact, sum((abs(pi - intensity) <= 1)::INT) AS within_one, sum((pp = is_push)::INT) AS push_match, round(avg(len(list_intersect(tt, pt)) / len(tt)), 4) AS ticker_recall, count(*) AS recall_n FROM t"""))
def holdout_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = V.read(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    truth = o.select(k.alias("case_id"), (k % 5 + 1).alias("intensity"), (k % 2 == 0).alias("is_push"),
                     F.array(F.concat(F.lit("T"), (c % 7).cast("string")), F.concat(F.lit("9"), (c % 3).cast("string"))).alias("beneficiaries"))
    pred = o.select(k.alias("case_id"), (c % 5 + 1).alias("intensity"), (c % 2 == 0).alias("should_push"), F.array(F.concat(F.lit("t"), (k % 7).cast("string"))).alias("tickers"))
    return A.holdout_metrics(pred, truth)


@query(sql("SELECT count(*) AS n, round(avg(abs(impact_score / 100 - (news_id % 100) / 100.0)), 4) AS mean_gap, round(max(abs(impact_score / 100 - (news_id % 100) / 100.0)), 4) AS max_gap FROM v_assess", "v_assess"))
def benchmark_gap(spark: SparkSession, d: str) -> DataFrame:
    a = V.assessments(spark, d)
    return A.benchmark_gap(a.select("id", (F.col("impact_score") / 100).alias("score")), a.select("id", ((F.col("news_id") % 100) / 100).alias("benchmark")))


AB = "SELECT id AS case_id, impact_score, id % 50 + 0.0 AS confidence, 50.0 AS greed_index, sentiment AS urgency, category AS sentiment FROM v_assess"


@query(sql(f"""WITH a AS ({AB} WHERE id % 11 <> 0), b AS (SELECT case_id, impact_score + case_id % 9 AS impact_score, confidence, greed_index, CASE WHEN case_id % 6 = 0 THEN 'FLASH' ELSE urgency END AS urgency, sentiment FROM ({AB}) WHERE case_id % 13 <> 0),
 j AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, a.case_id IS NULL AS no_a, b.case_id IS NULL AS no_b, a.impact_score AS i1, b.impact_score AS i2, a.urgency AS u1, b.urgency AS u2 FROM a FULL JOIN b ON a.case_id = b.case_id),
 l AS (SELECT case_id, no_a, no_b, unnest(['impact_score', 'confidence', 'greed_index', 'urgency', 'sentiment']) AS field, i1, i2, u1, u2 FROM j)
 SELECT case_id, field, CASE WHEN no_a THEN 'old failed' WHEN no_b THEN 'new failed' ELSE 'changed' END AS kind FROM l WHERE no_a OR no_b OR (field = 'impact_score' AND abs(i2 - i1) >= 5) OR (field = 'urgency' AND u1 <> u2)""", "v_assess"))
def prompt_ab_diff(spark: SparkSession, d: str) -> DataFrame:
    a = V.assessments(spark, d)
    k = F.col("id")
    run = a.select(k.alias("case_id"), "impact_score", (k % 50 + 0.0).alias("confidence"), F.lit(50.0).alias("greed_index"),
                   F.col("sentiment").alias("urgency"), F.col("category").alias("sentiment"))
    c = F.col("case_id")
    other = (run.withColumn("impact_score", F.col("impact_score") + c % 9)
             .withColumn("urgency", F.when(c % 6 == 0, "FLASH").otherwise(F.col("urgency"))))
    return A.prompt_ab_diff(run.filter(c % 11 != 0), other.filter(c % 13 != 0)).select("case_id", "field", "kind")


# --- health -------------------------------------------------------------------------------------
@query(sql(f"""SELECT a.n AS assessments, e.n AS errors, round((a.n - e.n) / greatest(a.n, 1) * 100, 1) AS success_rate FROM
 (SELECT count(*) AS n FROM (SELECT TIMESTAMP '2024-01-01' + INTERVAL (id % 43200) MINUTE AS created_at FROM v_assess) WHERE created_at > {AS_OF} - INTERVAL 48 HOUR) a,
 (SELECT count(*) AS n FROM v_health WHERE created_at > {AS_OF} - INTERVAL 48 HOUR AND event_type NOT LIKE 'watchdog_%') e""", "v_assess", "v_health"))
def health_stats(spark: SparkSession, d: str) -> DataFrame:
    a = V.assessments(spark, d).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 43200) * 60))
    return A.health_stats(a, V.health(spark, d), V.ts(V.AS_OF), 48)


STREAK = """t AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY source ORDER BY ts, event_id) AS g FROM v_cycles),
 s AS (SELECT *, CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY source, g ORDER BY ts, event_id) ELSE 0 END AS streak FROM t),
 p AS (SELECT *, coalesce(lag(streak) OVER (PARTITION BY source ORDER BY ts, event_id), 0) AS before FROM s)"""


@query(sql(f"""WITH {STREAK} SELECT source, event_id, CASE WHEN streak = 3 THEN 'source_stall' ELSE 'source_recovered' END AS event_type FROM p
 WHERE streak = 3 OR (NOT failed AND before >= 3)""", "v_cycles"))
def source_stalls(spark: SparkSession, d: str) -> DataFrame:
    return W.source_streaks(V.cycles(spark, d), tie="event_id").select("source", "event_id", "event_type")


@query(sql("""SELECT source FROM (SELECT split_part(detail, ':', 1) AS source, arg_max(event_type, row(created_at, event_type)) AS latest FROM v_health
 WHERE event_type IN ('source_stall', 'source_recovered') GROUP BY 1) WHERE latest = 'source_stall'""", "v_health"))
def active_stalls(spark: SparkSession, d: str) -> DataFrame:
    return W.active_stalls(V.health(spark, d))


@query(sql("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS ingest_1h, sum((event_type = 'purchase')::INT) AS assessments_1h, sum((event_type = 'error')::INT) AS errors_1h FROM events GROUP BY 1),
 g AS (SELECT *, CASE WHEN dayofweek(hour) IN (0, 6) THEN 4 ELSE 13 END AS ingest_floor, round((assessments_1h - errors_1h) / greatest(assessments_1h, 1) * 100, 1) AS success_rate FROM h)
 SELECT hour, CASE WHEN ingest_1h > 0 AND assessments_1h = 0 AND ingest_1h >= ingest_floor THEN 'degraded' WHEN assessments_1h >= 5 AND success_rate < 50 THEN 'degraded' WHEN ingest_1h < ingest_floor THEN 'quiet_ok' ELSE 'healthy' END AS state,
 (ingest_1h > 0 AND assessments_1h = 0 AND ingest_1h >= ingest_floor) OR (assessments_1h >= 5 AND success_rate < 50) AS should_alert FROM g"""))
def health_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("hour", "state", "should_alert")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    kind = F.col("event_type")
    h = e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.count("*").alias("ingest_1h"), F.sum((kind == "purchase").cast("int")).alias("assessments_1h"), F.sum((kind == "error").cast("int")).alias("errors_1h"))
    h = (h.withColumn("ingest_floor", X.ingest_floor(F.col("hour"), 13)).withColumn("hours_since_push", F.lit(5.0))
         .withColumn("success_rate", F.round((F.col("assessments_1h") - F.col("errors_1h")) / F.greatest("assessments_1h", F.lit(1)) * 100, 1))
         .withColumn("stalled", F.array().cast("array<string>")))
    return X.health_verdict(h)


@query(sql("""WITH RECURSIVE v AS MATERIALIZED (SELECT 'p' || CAST(user_id % 20 AS VARCHAR) AS pipeline, ts, event_id, event_type IN ('error', 'view', 'click') AS bad, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events),
 f(pipeline, k, run, last, alerted) AS (SELECT DISTINCT pipeline, 0::BIGINT, 0::BIGINT, TIMESTAMP '1970-01-01', false FROM v UNION ALL
 SELECT v.pipeline, v.k, CASE WHEN v.bad THEN f.run + 1 ELSE 0 END, CASE WHEN v.bad AND f.run + 1 >= 2 AND epoch(v.ts) - epoch(f.last) >= 21600 THEN v.ts ELSE f.last END, v.bad AND f.run + 1 >= 2 AND epoch(v.ts) - epoch(f.last) >= 21600
 FROM f JOIN v ON v.pipeline = f.pipeline AND v.k = f.k + 1)
 SELECT v.event_id, f.alerted FROM f JOIN v ON v.pipeline = f.pipeline AND v.k = f.k"""))
def debounced_alerts(spark: SparkSession, d: str) -> DataFrame:
    c = V.cycles(spark, d).select(F.regexp_replace("source", "src", "p").alias("pipeline"), "ts", "event_id", F.col("failed").alias("should_alert"))
    return O.debounce_alerts(c, cooldown_seconds=21600, tie="event_id").select("event_id", "alerted")


@query(sql("""SELECT source, count(*) AS alerts, round(avg(s), 1)::DOUBLE AS mean_seconds, round(max(s), 1)::DOUBLE AS max_seconds FROM (SELECT source, (news_id % 600) + 5 AS s FROM v_news WHERE news_id % 7 <> 0) GROUP BY source""", "v_news"))
def push_latency(spark: SparkSession, d: str) -> DataFrame:
    n = V.news(spark, d)
    a = n.select("source", F.when(F.col("news_id") % 7 != 0, F.col("captured_at")).alias("published_at"),
                 F.timestamp_seconds(F.unix_timestamp("captured_at") + F.col("news_id") % 600 + 5).alias("pushed_at"))
    return A.push_latency(a)
