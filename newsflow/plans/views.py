"""The given tables seen as the domain tables (news, headlines, flow, assessments, ...).

``VIEW_SQL`` states the same definitions for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = "2024-01-31 00:00:00"
AS_OF_ORDERS = "1998-01-01 00:00:00"

TOPICS = ["the", "and", "ation", "ich", "que", "los"]

# {q} is the quantity, {s} the supplier number of the line.
TEMPLATES = [
    "CPI rose {q}% vs 20% expected in {s}",
    "BREAKING: factory orders {q}K vs 25K forecast, treasury yields surge",
    "Company {s} beats estimates, raises guidance after record profit",
    "URGENT - Retailer {s} misses forecasts and cuts guidance",
    "Chipmakers raise memory chip prices by {q}% as demand exceeds supply",
    "Pentagon awards Intel a defense contract worth ${q} billion",
    "White House signs executive order on rare earth funding {s}",
    "Jensen Huang invests in Marvell, calls $MRVL the next trillion dollar company",
    "NVIDIA enters the PC market with its first processor, threatens AMD",
    "Venezuela election protest enters day {q}",
    "Iran oil supply risk lifts crude to ${q}, OPEC meets",
    "ECB holds rates as Germany inflation slows to {q}%",
    "Nikkei and Yen fall after Bank of Japan decision {s}",
    "Stock {s} up {q}% after analyst upgrade",
    "Trump interview on campaign trail draws crowd of {s}",
    "New minister sworn in after election of {s}",
    "FDA approval for drug {s} lifts $PFE shares",
    "Bitcoin and gold jump while dollar index slips {q} bps",
    "突发: 商务部拨款补贴芯片企业 {s}",
    "某公司 {s} 涨停 尾盘拉升",
    "党委学习贯彻重要讲话 {s}",
    "Fed rate cut expected ahead of jobs report {s}",
    "Acme acquires Widget {s} for ${q} billion, CEO steps down",
    "Tariff threat: government may impose duty of {q}% on autos",
    "JUST IN: Apple and Microsoft cloud partnership with Tesla {s}",
    "Weekly market recap: worst month since {s}, nasdaq flat",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores by key: the given files have one row group, which a scan gives to one task."""
    return df.repartition(spark.sparkContext.defaultParallelism, *keys)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return dealt(spark, d.select(
        i.alias("news_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("snippet"),
        F.concat(F.lit("https://"), "source", F.lit(".example/n/"), (i % 700).cast("string"), F.lit("?utm_source="), "lang",
                 F.lit("#top")).alias("url"),
        "source", "lang",
        F.timestamp_seconds(F.lit(1704067200) + (i % 30) * 86400 + (i % 1440) * 60).alias("captured_at"),
        F.element_at(F.array(*[F.lit(s) for s in ("pending", "fast_pushed", "deep_pushed", "archived")]),
                     (i % 4 + 1).cast("int")).alias("status"),
        (((i * 37) % 1000) / 1000.0).alias("priority_score"), "text"), "news_id")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finance headlines written from the lines of the order table."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return headlines_of(dealt(spark, li, "l_orderkey", "l_linenumber"))


def headlines_of(li: DataFrame) -> DataFrame:
    t = F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), (F.col("l_partkey") % len(TEMPLATES) + 1).cast("int"))
    title = F.replace(F.replace(t, F.lit("{q}"), F.col("l_quantity").cast("int").cast("string")), F.lit("{s}"),
                      F.col("l_suppkey").cast("string"))
    hid = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    source = F.element_at(F.array(*[F.lit(s) for s in ("Bloomberg", "CNBC", "ZeroHedge", "Blog", "")]),
                          (F.col("l_suppkey") % 5 + 1).cast("int"))
    return li.select(hid.alias("news_id"), title.alias("title"), F.lit("").alias("snippet"), source.alias("source"),
                     F.col("l_shipdate").cast("timestamp").alias("captured_at"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


REACTIONS = {"click": "thumbs_up", "error": "thumbs_down", "view": "ignore", "purchase": "analyze",
             "signup": "content_good"}


def _by_key(column: str, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("news_id"), _by_key("event_type", REACTIONS).alias("reaction"),
                    F.col("ts").cast("timestamp").alias("ts"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection cycles; two of five event types count as failed so that streaks occur."""
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
                    F.col("ts").cast("timestamp").alias("ts"), "event_id",
                    F.col("event_type").isin("error", "view", "click").alias("failed"))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = _by_key("event_type", {"error": "source_stall", "click": "source_recovered", "view": "watchdog_healthy",
                                  "purchase": "llm_timeout", "signup": "watchdog_degraded"})
    detail = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit(":"), F.col("user_id").cast("string"))
    return e.select(kind.alias("event_type"), detail.alias("detail"), F.col("ts").cast("timestamp").alias("created_at"))


CATEGORIES = {"1-URGENT": "monetary", "2-HIGH": "geopolitical", "3-MEDIUM": "macro_data",
              "4-NOT SPECIFIED": "corporate", "5-LOW": "regulatory"}


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.col("o_custkey").alias("news_id"), _by_key("o_orderpriority", CATEGORIES).alias("category"),
                    F.round(F.col("o_totalprice") % 100, 2).alias("impact_score"),
                    F.when(k % 2 == 0, "v1").otherwise("v2").alias("version"),
                    F.element_at(F.array(*[F.lit(s) for s in ("BULLISH", "BEARISH", "NEUTRAL")]), (k % 3 + 1).cast("int")).alias("sentiment"),
                    F.col("o_orderdate").cast("timestamp").alias("created_at"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    w = F.element_at(F.array(F.lit("15m"), F.lit("1h"), F.lit("4h")), (F.col("l_linenumber") - 1) % 3 + 1)
    # one measurement per assessment and window
    return (li.groupBy(F.col("l_orderkey").alias("assessment_id"), w.alias("window"))
            .agg(F.max(F.round(F.col("l_extendedprice") % 100, 2)).alias("actual_score"),
                 F.max(F.col("l_shipdate").cast("timestamp")).alias("collected_at")))


def fund_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly flows per supplier in whole units, so that sums are exact."""
    li = read(spark, sf_dir, "lineitem")
    amount = F.round(F.col("l_extendedprice")) * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    q = F.col("l_quantity")

    def tier(cond: Column) -> Column:
        return F.sum(F.when(cond, amount).otherwise(F.lit(0.0)))

    g = li.groupBy(F.col("l_suppkey").cast("string").alias("ticker"),
                   F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(
        tier(q >= 40).alias("super_net"), tier((q >= 25) & (q < 40)).alias("big_net"),
        tier((q >= 10) & (q < 25)).alias("mid_net"), tier(q < 10).alias("small_net"),
        (F.sum(F.round("l_extendedprice")) / F.sum("l_quantity")).alias("raw_close"))
    gross = F.abs("super_net") + F.abs("big_net") + F.abs("mid_net") + F.abs("small_net")
    main = F.col("super_net") + F.col("big_net")
    return g.select("ticker", "date", main.alias("main_net"), F.lit(0.0).alias("main_in_flow"), "super_net", "big_net",
                    "mid_net", "small_net", F.coalesce(F.round(F.try_divide(main * 100, gross), 2), F.lit(0.0)).alias("main_pct"),
                    (F.floor(F.col("raw_close") * 100 + 0.5) / 100).alias("close"), F.lit(0.0).alias("change_pct"))


def sector_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    n = read(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("sector"), F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_suppkey").alias("position"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                                                F.col("value").alias("close"), "event_id")


_templates = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TEMPLATES) + "]"


def _case(column: str, table: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


VIEW_SQL = {
    "v_news": """SELECT doc_id AS news_id, split_part(text, chr(10), 1) AS title, text AS snippet,
 'https://' || source || '.example/n/' || CAST(doc_id % 700 AS VARCHAR) || '?utm_source=' || lang || '#top' AS url, source, lang,
 TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 30) DAY + INTERVAL (doc_id % 1440) MINUTE AS captured_at,
 (['pending', 'fast_pushed', 'deep_pushed', 'archived'])[doc_id % 4 + 1] AS status,
 ((doc_id * 37) % 1000) / 1000.0 AS priority_score, text FROM documents""",
    "v_headlines": f"""SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS news_id,
 replace(replace(({_templates})[l_partkey % {len(TEMPLATES)} + 1], '{{q}}', CAST(CAST(l_quantity AS INT) AS VARCHAR)), '{{s}}', CAST(l_suppkey AS VARCHAR)) AS title,
 '' AS snippet, (['Bloomberg', 'CNBC', 'ZeroHedge', 'Blog', ''])[l_suppkey % 5 + 1] AS source, l_shipdate AS captured_at FROM lineitem""",
    "v_feedback": f"SELECT user_id AS news_id, {_case('event_type', REACTIONS)} AS reaction, ts FROM events",
    "v_cycles": "SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS source, ts, event_id, event_type IN ('error', 'view', 'click') AS failed FROM events",
    "v_health": f"""SELECT {_case('event_type', {"error": "source_stall", "click": "source_recovered", "view": "watchdog_healthy", "purchase": "llm_timeout", "signup": "watchdog_degraded"})} AS event_type,
 'src' || CAST(user_id % 20 AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS detail, ts AS created_at FROM events""",
    "v_assess": f"""SELECT o_orderkey AS id, o_custkey AS news_id, {_case('o_orderpriority', CATEGORIES)} AS category,
 round(o_totalprice % 100, 2) AS impact_score, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version,
 (['BULLISH', 'BEARISH', 'NEUTRAL'])[o_orderkey % 3 + 1] AS sentiment, o_orderdate AS created_at FROM orders""",
    "v_outcomes": """SELECT l_orderkey AS assessment_id, (['15m', '1h', '4h'])[(l_linenumber - 1) % 3 + 1] AS "window",
 max(round(l_extendedprice % 100, 2)) AS actual_score, max(l_shipdate) AS collected_at
 FROM lineitem GROUP BY 1, 2""",
    "v_flow": """SELECT ticker, date, super_net + big_net AS main_net, 0.0::DOUBLE AS main_in_flow, super_net, big_net, mid_net, small_net,
 coalesce(round((super_net + big_net) * 100 / nullif(abs(super_net) + abs(big_net) + abs(mid_net) + abs(small_net), 0), 2), 0) AS main_pct,
 floor(raw_close * 100 + 0.5) / 100 AS close, 0.0::DOUBLE AS change_pct FROM (
 SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
 sum(CASE WHEN l_quantity >= 40 THEN a ELSE 0 END) AS super_net, sum(CASE WHEN l_quantity >= 25 AND l_quantity < 40 THEN a ELSE 0 END) AS big_net,
 sum(CASE WHEN l_quantity >= 10 AND l_quantity < 25 THEN a ELSE 0 END) AS mid_net, sum(CASE WHEN l_quantity < 10 THEN a ELSE 0 END) AS small_net,
 sum(abs(a)) / sum(l_quantity) AS raw_close
 FROM (SELECT *, round(l_extendedprice) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS a FROM lineitem) GROUP BY 1, 2)""",
    "v_stocks": """SELECT n_name AS sector, CAST(s_suppkey AS VARCHAR) AS ticker, s_suppkey AS position
 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_prices": "SELECT event_type AS symbol, ts, value AS close, event_id FROM events",
}


def sql(body: str, *views: str) -> str:
    """SQL text with the named views as common table expressions."""
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body.lstrip()[15:]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, {body.lstrip()[5:]}"
    return f"WITH {ctes} {body}"
