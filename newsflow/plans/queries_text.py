"""Queries over headline text: numbers, keywords, filters, tags, scores, decisions, feed shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import views as V
from ..functions import dictionaries as D
from ..functions import entities as E
from ..functions import predicates as P
from ..functions import signal_words as S
from ..functions import strategic as Z
from ..functions import text as T
from ..functions.lexicon import Lexicon
from ..functions.vocabulary import entity_lists, filter_lists, score_lists, strategic_lists
from ..operators import aggregates as A
from ..operators import decisions as X
from ..operators import grounding as U
from ..operators import joins as J  # noqa: F401
from ..operators import ranking as R
from ..operators import scoring as C
from ..operators import tagging as G
from ..operators import windows as W
from ..runtime import checkpoint
from ..sources import feeds, flows, responses
from .registry import query
from .strategic_sql import strategic_ctes
from .views import sql

AS_OF = f"TIMESTAMP '{V.AS_OF}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in dict.fromkeys(words)) + ")"


def max_sql(c: str, weights: dict[str, float]) -> str:
    return "greatest(0.0, " + ", ".join(f"CASE WHEN contains({c}, {q(w)}) THEN {v} ELSE 0 END" for w, v in weights.items()) + ")"


def rx_sql(c: str, patterns, flags: str = "(?i)") -> str:
    return f"regexp_matches({c}, {q(flags + '|'.join('(?:' + p + ')' for p in patterns))})"


def title(spark: SparkSession, d: str) -> tuple[DataFrame, F.Column]:
    return V.headlines(spark, d), F.col("title")


def per_title(spark: SparkSession, d: str, work, keys=("title",), also=()) -> DataFrame:
    """``work`` on the distinct titles of the headlines, with the news ids (and ``also``) joined to the result."""
    return T.once_per_value(V.headlines(spark, d).select("news_id", *keys, *also), list(keys), work)


# --- numbers and keywords -----------------------------------------------------------------------
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN l_quantity WHEN 2 THEN -l_quantity * 1000000 ELSE NULL END AS number FROM lineitem""")
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_linenumber") % 4
    text = (F.when(k == 0, F.concat(n, F.lit(",000"))).when(k == 1, F.concat(F.lit("+"), n, F.lit("%")))
            .when(k == 2, F.concat(F.lit("−"), n, F.lit("M"))).otherwise(F.concat(n, F.lit(" or so"))))
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.parse_number(text).alias("number"))


BAND = "CASE WHEN x >= 0.40 THEN 1.0 WHEN x >= 0.15 THEN 0.9 WHEN x >= 0.07 THEN 0.7 WHEN x >= 0.04 THEN 0.5 WHEN x >= 0.02 THEN 0.35 ELSE 0.2 END"


@query(sql(f"""WITH n AS (SELECT news_id, title, CASE WHEN title LIKE 'CPI rose%' THEN abs(CAST(regexp_extract(title, 'rose (\\d+)%', 1) AS DOUBLE) - 20) / 20
 WHEN title LIKE 'BREAKING: factory%' THEN abs(CAST(regexp_extract(title, 'orders (\\d+)K', 1) AS DOUBLE) - 25) / 25 END AS x FROM v_headlines)
 SELECT news_id, round(CASE WHEN x IS NOT NULL THEN {BAND} WHEN contains(title, 'beats estimates') THEN 0.4 WHEN contains(title, 'misses forecasts') THEN 0.5 ELSE 0 END * 0.25, 4)::DOUBLE AS score FROM n""", "v_headlines"))
def deviation_scores(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    return h.select("news_id", T.deviation_score(t).alias("score"))


@query(sql(f"""SELECT news_id, round({max_sql('lower(title)', D.SURPRISE_WEIGHTS)} * 0.15, 4)::DOUBLE AS surprise,
 round(greatest({max_sql('lower(title)', D.BUSINESS_IMPACT_WEIGHTS)}, CASE WHEN regexp_matches(lower(title), {q(D.PRICE_RAISE)}) THEN 0.9 ELSE 0 END) * 0.15, 4)::DOUBLE AS business FROM v_headlines""", "v_headlines"))
def keyword_intensity(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")

    def work(h: DataFrame) -> DataFrame:
        h, found = Lexicon(score_lists()).add(h, F.lower(t))
        return T.once(h, surprise=T.surprise_score(t, found=found), business=T.business_impact_score(t, found=found))

    return per_title(spark, d, work).select("news_id", "surprise", "business")


@query(sql("SELECT news_id, " + " + ".join(any_sql("lower(title)", w) + "::INT" for w in D.ASSET_CLASSES.values()) + " AS classes FROM v_headlines", "v_headlines"))
def asset_class_counts(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    return h.select("news_id", T.asset_class_count(t).alias("classes"))


@query(sql(f"SELECT news_id, {rx_sql('title', D.BREAKING_MARKERS)} AS breaking FROM v_headlines", "v_headlines"))
def breaking_flags(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    return h.select("news_id", T.is_breaking(t).alias("breaking"))


# --- filters --------------------------------------------------------------------------------------
LOW = "lower(title)"
HOT_NAME = f"regexp_matches({LOW}, {q('(?i)' + chr(92) + 'b(?:' + '|'.join(D.HOTSPOT_NAMES) + ')' + chr(92) + 'b')})"
PARTY = any_sql("title", D.HOTSPOT_PARTY)
POLITICAL = any_sql(LOW, [w.lower() for w in D.POLITICAL_ACTIONS])
CONNECTED = any_sql(LOW, [w.lower() for w in D.US_MARKET_CONNECTORS])
GEO = f"CASE WHEN NOT ({HOT_NAME} OR {PARTY} OR {any_sql('title', D.HOTSPOT_NAMES_CJK)}) OR {CONNECTED} THEN 1.0 WHEN {POLITICAL} AND {PARTY} AND NOT {HOT_NAME} THEN 0.15 WHEN {POLITICAL} THEN 0.2 ELSE 0.6 END"
US = f"({rx_sql(LOW, D.US_TIER_PATTERNS)} OR {any_sql('title', D.US_TIER_CJK)})"
ABROAD = f"({rx_sql(LOW, D.NON_US_PATTERNS)} OR {any_sql('title', D.NON_US_CJK)})"
TIER = f"CASE WHEN {US} THEN 1.0 WHEN {ABROAD} THEN 0.25 ELSE 1.0 END"
MULTI = "(" + " + ".join(any_sql(LOW, w) + "::INT" for w in D.BROAD_ASSET_CLASSES.values()) + " >= 2)"
MOVE, DEAL = rx_sql(LOW, D.MASSIVE_MOVE_PATTERNS, ""), rx_sql(LOW, D.DEAL_PATTERNS, "")
LEADER, DRUG = rx_sql(LOW, D.LEADER_CHANGE_PATTERNS, ""), any_sql(LOW, D.DRUG_SIGNALS)
MAJOR = f"(({any_sql(LOW, D.MEGA_CAPS)} AND ({LEADER} OR {DRUG})) OR {MOVE} OR {DEAL})"
NOISE = f"({rx_sql(LOW, D.A_SHARE_PATTERNS, '')} OR ({rx_sql(LOW, D.SINGLE_STOCK_PATTERNS)} AND NOT {MULTI} AND NOT {MAJOR}))"
GOSSIP = rx_sql(LOW, D.GOSSIP_PATTERNS)
ROUTINE = f"({rx_sql(LOW, D.ROUTINE_POLITICS_PATTERNS)} AND NOT {any_sql(LOW, D.ROUTINE_POLITICS_REDEEMERS)})"
PROPAGANDA = f"({any_sql(LOW, D.PROPAGANDA_MARKERS)} AND NOT {any_sql(LOW, D.PROPAGANDA_REDEEMERS)})"
CHINESE = "(length(regexp_replace(title, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) > 0.25 * length(regexp_replace(title, '[^\\p{L}]', '', 'g')))"
QUALITY = f"CASE WHEN {PROPAGANDA} THEN 0.15 ELSE least(1.0, CASE WHEN {CHINESE} AND NOT {any_sql(LOW, D.US_SIGNALS)} THEN 0.5 ELSE 1 END, CASE WHEN {NOISE} THEN 0.3 ELSE 1 END, CASE WHEN {GOSSIP} THEN 0.3 ELSE 1 END, CASE WHEN {ROUTINE} THEN 0.2 ELSE 1 END) END"


@query(sql(f"SELECT news_id, ({GEO})::DOUBLE AS geo, ({TIER})::DOUBLE AS tier FROM v_headlines", "v_headlines"))
def geo_multipliers(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")

    def work(h: DataFrame) -> DataFrame:
        h, found = Lexicon(filter_lists()).add(h, F.lower(t))
        return T.once(h, geo=P.geo_market_multiplier(t, found), tier=P.geo_tier_weight(t, F.lit(False)))

    return per_title(spark, d, work).select("news_id", "geo", "tier")


@query(sql(f"SELECT news_id, ({QUALITY})::DOUBLE AS quality FROM v_headlines", "v_headlines"))
def content_quality(spark: SparkSession, d: str) -> DataFrame:
    def work(h: DataFrame) -> DataFrame:
        h, found = Lexicon(filter_lists()).add(h, F.lower("title"))
        return T.once(h, quality=P.content_quality_multiplier(F.col("title"), F.lit(False), F.lit(False), found))

    return per_title(spark, d, work).select("news_id", "quality")


@query(sql(f"SELECT news_id, {PROPAGANDA} AS propaganda, {NOISE} AS noise, {MAJOR} AS major, {GOSSIP} AS gossip, {ROUTINE} AS routine, {any_sql(LOW, D.US_SIGNALS)} AS us_signal, {MULTI} AS multi_asset FROM v_headlines", "v_headlines"))
def content_predicates(spark: SparkSession, d: str) -> DataFrame:
    t, no = F.col("title"), F.lit(False)
    made = {"propaganda": P.is_propaganda(t), "noise": P.is_single_stock_noise(t, no), "major": P.is_major_stock_event(t, no),
            "gossip": P.is_political_gossip(t, no), "routine": P.is_routine_politics(t, no), "us_signal": P.has_us_signal(t, no),
            "multi_asset": P.has_multi_asset(t)}
    return per_title(spark, d, lambda h: T.once(h, **made)).select("news_id", *made)


@query(sql(f"""SELECT news_id, least(CASE WHEN {rx_sql(LOW, S.RETROSPECTIVE_PATTERNS, '')} THEN 0.5 ELSE 1 END, CASE WHEN {rx_sql(LOW, S.THREAT_PATTERNS, '')} THEN 0.65 ELSE 1 END,
 CASE WHEN {rx_sql(LOW, [S.PERSONNEL_PATTERN], '')} AND NOT {rx_sql(LOW, [S.POLICY_PATTERN], '')} THEN 0.55 ELSE 1 END)::DOUBLE AS penalty FROM v_headlines""", "v_headlines"))
def quality_penalties(spark: SparkSession, d: str) -> DataFrame:
    return per_title(spark, d, lambda h: T.once(h, penalty=P.content_quality_penalty(F.col("title")))).select("news_id", "penalty")


@query(sql(f"SELECT news_id FROM v_headlines WHERE NOT {any_sql('title', D.NOISE_TITLE_WORDS)}", "v_headlines"))
def noise_free_titles(spark: SparkSession, d: str) -> DataFrame:
    return R.drop_noise_titles(V.headlines(spark, d)).select("news_id")


MACRO_CASE = "CASE WHEN " + any_sql(LOW, [w.lower() for w in E.PREVIEW_WORDS]) + " THEN NULL " + " ".join(
    f"WHEN contains({LOW}, {q(w.lower())}) THEN {q(i)}" for i, (_, ws) in E.MACRO_INDICATORS.items() for w in ws) + " END"


@query(sql(f"SELECT news_id, {MACRO_CASE} AS indicator, {any_sql(LOW, [w.lower() for _, ws in E.MACRO_INDICATORS.values() for w in ws])} AS exempt FROM v_headlines", "v_headlines"))
def macro_indicators(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    h = per_title(spark, d, lambda h: T.once(h, indicator=P.macro_indicator(t)["indicator"], exempt=P.is_macro_title(t)))
    return h.select("news_id", "indicator", "exempt")


@query(sql("""SELECT id, array_to_string(list_filter([CASE WHEN k < 4 OR k > 6 THEN 'reasoning_chain has ' || k || ' steps, expected ~5' END, CASE WHEN k = 7 THEN 'empty reasoning step' END,
 CASE WHEN id % 3 = 0 AND impact_score < 30 THEN 'cross_asset with low score' END, CASE WHEN category = 'monetary' AND impact_score < 20 THEN 'monetary event scored too low' END], lambda x: x IS NOT NULL), '; ') AS issues FROM (SELECT *, id % 6 + 2 AS k FROM v_assess)""", "v_assess"))
def explainability_issues(spark: SparkSession, d: str) -> DataFrame:
    a = V.assessments(spark, d).withColumn("k", (F.col("id") % 6 + 2).cast("int"))
    steps = F.transform(F.sequence(F.lit(1), "k"), lambda i: F.when((i == 7), "").otherwise("step"))
    breadth = F.when(F.col("id") % 3 == 0, "cross_asset").otherwise("sector")
    return a.select("id", F.array_join(P.explainability_issues(steps, breadth, F.col("category"), F.col("impact_score")), "; ").alias("issues"))


@query(sql("SELECT id, impact_score FROM v_assess WHERE impact_score / 100 BETWEEN 0.30 AND 0.70", "v_assess"))
def borderline_signals(spark: SparkSession, d: str) -> DataFrame:
    return V.assessments(spark, d).filter(P.is_borderline(F.col("impact_score") / 100)).select("id", "impact_score")


@query(sql("SELECT o_custkey AS user_id, 'T' || CAST(o_orderkey % 50 AS VARCHAR) AS ticker, o_orderdate AS until FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'"))
def active_mutes(spark: SparkSession, d: str) -> DataFrame:
    prefs = V.read(spark, d, "orders").select("o_custkey", F.lit("muted_tickers").alias("key"), F.to_json(F.create_map(
        F.concat(F.lit("T"), (F.col("o_orderkey") % 50).cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))).alias("value"))
    muted = prefs.select(F.col("o_custkey").alias("user_id"), "key", "value")
    return R.active_mutes(muted, V.ts(V.AS_OF_ORDERS), keep=("user_id",))


# --- tags -----------------------------------------------------------------------------------------
TOP_WORDS = ["then", "here", "tion", "ich", "ment", "ando", "zation", "eres"]


@query(sql("SELECT news_id, array_to_string(list_sort(list_filter([" + ", ".join(q(w) for w in TOP_WORDS) + "], lambda k: contains(lower(text), k))), ',') AS tags FROM v_news", "v_news"))
def dictionary_tags(spark: SparkSession, d: str) -> DataFrame:
    n = V.news(spark, d)
    return n.select("news_id", F.array_join(F.array_sort(G.tag_words(F.col("text"), TOP_WORDS)), ",").alias("tags"))



@query(sql("""WITH k AS (SELECT item_id AS tag, lower(text) AS keyword FROM benchmark) SELECT news_id, string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag) AS tags
 FROM v_news JOIN k ON contains(lower(text), keyword) GROUP BY news_id""", "v_news"))
def dictionary_table_tags(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary is a table; the size check sends it through the anchor join."""
    words = V.read(spark, d, "benchmark").select(F.col("item_id").alias("tag"), F.lower("text").alias("keyword"))
    t = G.tag_dictionary(V.news(spark, d), words)
    return t.select("news_id", F.array_join("tags", ",").alias("tags"))


@query(sql("""WITH k AS (SELECT item_id AS tag, lower(text) AS keyword FROM benchmark) SELECT news_id, tag FROM v_news JOIN k ON contains(lower(text), keyword)""", "v_news"))
def dictionary_anchor_join(spark: SparkSession, d: str) -> DataFrame:
    words = V.read(spark, d, "benchmark").select(F.col("item_id").alias("tag"), F.lower("text").alias("keyword"))
    return G.contains_join(V.news(spark, d), words, inline_limit=0).select("news_id", "tag")


NAMES = "[" + ", ".join("{'n': " + q(n) + ", 't': " + q(t) + "}" for n, t in {**E.COMPANY_TICKERS}.items() if t in E.KNOWN_TICKERS) + "]"
NAMES_CJK = "[" + ", ".join("{'n': " + q(n) + ", 't': " + q(t) + "}" for n, t in {**E.COMPANY_TICKERS_CJK}.items() if t in E.KNOWN_TICKERS) + "]"
KNOWN = "[" + ", ".join(q(t) for t in E.KNOWN_TICKERS) + "]"
TICKERS = f"""list_sort(list_distinct(list_concat(
 list_filter(list_transform(regexp_extract_all(title, '\\$?[A-Z]+'), lambda x: CASE WHEN length(replace(x, '$', '')) > 5 THEN '' WHEN x LIKE '$%' THEN substr(x, 2) WHEN list_contains({KNOWN}, x) THEN x ELSE '' END), lambda x: x <> ''),
 list_transform(list_filter({NAMES}, lambda k: contains(lower(title), k.n)), lambda k: k.t), list_transform(list_filter({NAMES_CJK}, lambda k: contains(title, k.n)), lambda k: k.t))))"""


@query(sql(f"SELECT news_id, array_to_string({TICKERS}, ',') AS tickers FROM v_headlines", "v_headlines"))
def tagged_tickers(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    return h.select("news_id", F.array_join(G.extract_tickers(t), ",").alias("tickers"))


PEOPLE = "CASE " + " ".join(f"WHEN {any_sql(LOW, [n.lower() for n, t in E.PEOPLE_TIERS.items() if t == k])} THEN {k}" for k in (1, 2, 3)) + " ELSE 1 END"


@query(sql(f"SELECT news_id, {PEOPLE} AS tier, {any_sql(LOW, [n.lower() for n in E.PEOPLE_TIERS])} AS found FROM v_headlines", "v_headlines"))
def people_tiers(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    return h.select("news_id", G.people_tier(t)["tier"].alias("tier"), G.people_tier(t)["found"].alias("found"))


TOPICS = "[" + ", ".join(f"{{'n': {' + '.join('contains(lower(title), ' + q(w.lower()) + ')::INT' for w in ws)}, 'i': {i}, 't': {q(t)}}}" for i, (t, ws) in enumerate(S.TOPIC_WORDS.items())) + "]"


@query(sql(f"SELECT news_id, coalesce(string_agg(t, ',' ORDER BY n DESC, i), '') AS topics FROM (SELECT news_id, k.n, k.i, k.t, row_number() OVER (PARTITION BY news_id ORDER BY k.n DESC, k.i) AS rn FROM (SELECT news_id, unnest({TOPICS}) AS k FROM v_headlines) WHERE k.n > 0) WHERE rn <= 5 GROUP BY news_id", "v_headlines"))
def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    work = T.topic_tags(F.col("title"))
    return per_title(spark, d, lambda h: T.once(h, topics=F.array_join(work, ",")).filter("topics <> ''")).select("news_id", "topics")


@query("""SELECT doc_id, round(least(10.0, 5.0 + CASE WHEN w BETWEEN 200 AND 2000 THEN 2.0 WHEN w BETWEEN 50 AND 199 THEN 1.0 WHEN w > 2000 THEN 1.5 ELSE 0 END + least(0.5 * ((contains(low, 'zation')::INT) + (contains(low, 'hereon')::INT)), 2.0)
 + CASE WHEN length(s) < length(text) * 0.8 AND s <> '' THEN 0.5 ELSE 0 END), 1)::DOUBLE AS quality FROM (SELECT doc_id, text, lower(text) AS low, substr(text, 1, 100) AS s, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)""")
def document_quality(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    topics = T.topic_tags(t, {"a": ["zation"], "b": ["hereon"]})
    return V.read(spark, d, "documents").select("doc_id", T.doc_quality(t, F.substring(t, 1, 100), topics).alias("quality"))


TOPIC_KEYS = "CASE WHEN regexp_matches(title, '(?i)CPI|inflation') THEN 'macro:inflation:up' WHEN regexp_matches(title, '(?i)Fed\\b|rate\\s*(?:cut|hike)') THEN 'macro:fed_rate:up' WHEN regexp_matches(title, '(?i)tariff') THEN 'macro:trade:up'"


@query(sql(f"SELECT news_id, {TOPIC_KEYS} WHEN regexp_matches(title, '(?i)ISM') THEN 'macro:pmi:up' ELSE 'headline:' || substr(md5(title), 1, 12) END AS dedup_key FROM v_headlines", "v_headlines"))
def suppression_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    work = T.dedup_key(F.array().cast("array<string>"), t, t, F.lit("up"))
    return per_title(spark, d, lambda h: T.once(h, dedup_key=work)).select("news_id", "dedup_key")


ETF_T = "MAP {" + ", ".join(f"{q(k)}: [" + ", ".join(q(x) for x in v) + "]" for k, v in E.TICKER_ETFS.items()) + "}"
ETF_E = "list_concat(" + ", ".join(f"CASE WHEN contains(upper(category), {q(k.upper())}) AND contains({q(k)}, {q(k)}) AND (contains('', {q(k)}) OR contains(lower(category), {q(k.lower())})) THEN [" + ", ".join(q(x) for x in v) + "] ELSE [] END" for k, v in E.EVENT_ETFS.items()) + ")"


@query(sql(f"""SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce({ETF_T}[t], []), {ETF_E}, CASE WHEN category IN ('monetary', 'geopolitical', 'macro_data') THEN ['SPY'] ELSE [] END))), ',') AS etfs
 FROM (SELECT id, category, (['NVDA', 'JPM', 'KTOS', 'ZZZ'])[id % 4 + 1] AS t FROM v_assess)""", "v_assess"))
def related_etfs(spark: SparkSession, d: str) -> DataFrame:
    t = F.element_at(F.array(*[F.lit(x) for x in ("NVDA", "JPM", "KTOS", "ZZZ")]), (F.col("id") % 4 + 1).cast("int"))
    return V.assessments(spark, d).select("id", F.array_join(G.ticker_to_etf(F.array(t), F.lit(""), F.col("category")), ",").alias("etfs"))


# --- strategic relations ---------------------------------------------------------------------------
@query(sql(f"""WITH {strategic_ctes('SELECT news_id AS id, title FROM v_headlines')}
 SELECT id AS news_id, category, text, conf::DOUBLE AS confidence FROM strategic""", "v_headlines"))
def strategic_matches(spark: SparkSession, d: str) -> DataFrame:
    def work(h: DataFrame) -> DataFrame:
        h, found = Lexicon(strategic_lists()).add(h, F.lower("title"))
        return h.withColumn("m", F.explode(Z.strategic_matches(F.col("title"), found=found)))

    return per_title(spark, d, work).select("news_id", "m.category", "m.text", F.col("m.conf").alias("confidence"))


# --- scores ---------------------------------------------------------------------------------------
SURP, BUS = max_sql(LOW, D.SURPRISE_WEIGHTS), max_sql(LOW, D.BUSINESS_IMPACT_WEIGHTS)
AUTH = "CASE source WHEN '' THEN 0.0 WHEN 'Bloomberg' THEN 0.10 WHEN 'CNBC' THEN 0.08 ELSE 0.03 END"
CLASSES = "(" + " + ".join(any_sql(LOW, w) + "::INT" for w in D.ASSET_CLASSES.values()) + ")"


@query(sql(f"""WITH n AS (SELECT *, CASE WHEN title LIKE 'CPI rose%' THEN abs(CAST(regexp_extract(title, 'rose (\\d+)%', 1) AS DOUBLE) - 20) / 20
 WHEN title LIKE 'BREAKING: factory%' THEN abs(CAST(regexp_extract(title, 'orders (\\d+)K', 1) AS DOUBLE) - 25) / 25 END AS x, len({TICKERS}) AS nt FROM v_headlines)
 SELECT news_id, round(CASE WHEN {rx_sql('title', D.BREAKING_MARKERS)} THEN 0.35 ELSE 0 END + least(0.24, nt * 0.08) + CASE WHEN contains({LOW}, 'jensen huang') THEN 0.15 ELSE 0 END + {AUTH}
 + round(CASE WHEN x IS NOT NULL THEN {BAND} WHEN contains(title, 'beats estimates') THEN 0.4 WHEN contains(title, 'misses forecasts') THEN 0.5 ELSE 0 END * 0.25, 4)
 + round({SURP} * 0.15, 4) + round((CASE {CLASSES} WHEN 0 THEN 0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 WHEN 3 THEN 0.9 ELSE 1.0 END) * 0.15, 4)
 + round(greatest({BUS}, CASE WHEN regexp_matches({LOW}, {q(D.PRICE_RAISE)}) THEN 0.9 ELSE 0 END) * 0.15, 4), 4)::DOUBLE AS score FROM n""", "v_headlines"))
def priority_scores(spark: SparkSession, d: str) -> DataFrame:
    people, t = {"Jensen Huang": 1}, F.col("title")

    def work(h: DataFrame) -> DataFrame:
        h, found = Lexicon({**score_lists(), **entity_lists(people=people)}).add(h, F.lower(t))
        tier = G.people_tier(t, people, found)
        return T.once(h, score=C.priority_score(t, T.is_breaking(t), F.lit(0), F.size(G.extract_tickers(t, found=found)), F.col("source"),
                                                tier["found"], tier["tier"], F.lit(0), found=found))

    return per_title(spark, d, work, ("title", "source")).select("news_id", "score")


MAJOR_H = f"(({any_sql(LOW, D.MEGA_CAPS)} AND (has OR {LEADER} OR {DRUG})) OR {MOVE} OR {DEAL} OR (({DRUG} OR {LEADER}) AND has))"
NOISE_H = f"({rx_sql(LOW, D.A_SHARE_PATTERNS, '')} OR ({rx_sql(LOW, D.SINGLE_STOCK_PATTERNS)} AND NOT {MULTI} AND NOT {MAJOR_H}))"
QUALITY_H = f"""CASE WHEN {PROPAGANDA} THEN 0.15 ELSE least(1.0, CASE WHEN {CHINESE} AND NOT (has OR {any_sql(LOW, D.US_SIGNALS)}) THEN 0.5 ELSE 1 END,
 CASE WHEN {NOISE_H} THEN 0.3 ELSE 1 END, CASE WHEN NOT has AND {GOSSIP} THEN 0.3 ELSE 1 END, CASE WHEN NOT has AND {ROUTINE} THEN 0.2 ELSE 1 END) END"""
MACRO_FOUND = "list_transform(list_filter([" + ", ".join("{'w': " + q(w) + ", 'l': " + q(w.lower()) + "}" for w in dict.fromkeys(E.MACRO_ALERTS)) + f"], lambda k: contains({LOW}, k.l)), lambda k: k.w)"
WATCHED = "list_filter([" + ", ".join(q(w) for w in E.DEFAULT_WATCHLIST) + "], lambda k: contains(upper(title), upper(k)))"
PEOPLE_BONUS = "CASE WHEN " + any_sql(LOW, [n.lower() for n in E.PEOPLE_TIERS]) + f" THEN CASE {PEOPLE} " + " ".join(f"WHEN {k} THEN {v}" for k, v in D.PEOPLE_TIER_WEIGHTS.items()) + " END ELSE 0 END"
PW = D.PRIORITY_WEIGHTS

RAW_SCORE = f"""CASE WHEN {rx_sql('title', D.BREAKING_MARKERS)} THEN {PW['breaking']} ELSE 0 END + least({PW['macro_cap']}, N_TAGS * {PW['macro_per_tag']}) + least({PW['ticker_cap']}, N_TICKERS * {PW['ticker_per_hit']}) + {PEOPLE_BONUS} + {AUTH}
  + round(CASE WHEN x IS NOT NULL THEN {BAND} WHEN contains(headline, 'beats estimates') THEN 0.4 WHEN contains(headline, 'misses forecasts') THEN 0.5 ELSE 0 END * {PW['deviation']}, 4)
  + round({SURP.replace(LOW, 'lower(headline)')} * {PW['surprise']}, 4) + round((CASE {CLASSES.replace(LOW, 'lower(headline)')} WHEN 0 THEN 0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 WHEN 3 THEN 0.9 ELSE 1.0 END) * {PW['asset_linkage']}, 4)
  + round(greatest({BUS.replace(LOW, 'lower(headline)')}, CASE WHEN regexp_matches(lower(headline), {q(D.PRICE_RAISE)}) THEN 0.9 ELSE 0 END) * {PW['business_impact']}, 4)"""


# the body is title, a blank and the empty snippet; scores read the title alone
SCREENED_SQL = sql(f"""WITH RECURSIVE b AS (SELECT news_id, title || ' ' AS title, title AS headline, source FROM v_headlines),
 {strategic_ctes('SELECT news_id AS id, title FROM b')},
 best AS (SELECT id, arg_min(category, seq - 10 * conf) AS best FROM strategic GROUP BY id),
 n AS (SELECT b.*, {TICKERS} AS tk, {MACRO_FOUND} AS mt, {WATCHED} AS watched, best,
  CASE WHEN headline LIKE 'CPI rose%' THEN abs(CAST(regexp_extract(headline, 'rose (\\d+)%', 1) AS DOUBLE) - 20) / 20
  WHEN headline LIKE 'BREAKING: factory%' THEN abs(CAST(regexp_extract(headline, 'orders (\\d+)K', 1) AS DOUBLE) - 25) / 25 END AS x FROM b LEFT JOIN best ON b.news_id = best.id),
 m AS (SELECT *, len(tk) > 0 AS has FROM n),
 f AS (SELECT *, ({GEO})::DOUBLE AS geo, round(({GEO})::DOUBLE * ({QUALITY_H})::DOUBLE * (CASE WHEN has THEN 1.0 ELSE {TIER} END)::DOUBLE, 3) AS mult FROM m),
 s AS (SELECT *, round({RAW_SCORE.replace('N_TAGS', 'len(mt)').replace('N_TICKERS', 'len(tk)')}, 4)::DOUBLE AS raw FROM f)
 SELECT news_id, p AS priority_score, CASE WHEN best IS NOT NULL AND geo > 0.2 THEN greatest(mult, 0.8) ELSE mult END AS filter_multiplier,
  array_to_string(list_concat(mt, CASE WHEN best IS NULL THEN [] ELSE ['STRATEGIC_' || upper(best)] END), ',') AS tags,
  array_to_string(list_sort(list_distinct(list_concat(tk, CASE WHEN best IS NULL THEN [] ELSE watched END))), ',') AS tickers
 FROM (SELECT *, CASE WHEN best IS NOT NULL AND geo > 0.2 THEN greatest(round(raw * mult, 4), 1.0) ELSE round(raw * mult, 4) END AS p FROM s) WHERE p >= 0.30""", "v_headlines")


@query(SCREENED_SQL)
def screened_headlines(spark: SparkSession, d: str) -> DataFrame:
    s = C.screen(V.headlines(spark, d))
    return s.select("news_id", "priority_score", "filter_multiplier", F.array_join("macro_tags", ",").alias("tags"), F.array_join("tickers", ",").alias("tickers"))


TYPE_CASE = "CASE " + " ".join(f"WHEN {any_sql(LOW, ws)} THEN {q(k)}" for k, ws in S.TEXT_EVENT_TYPES.items()) + " ELSE '' END"
HALF = "CASE t " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in S.HALF_LIFE_MINUTES.items()) + " ELSE 30 END"


@query(sql(f"""WITH n AS (SELECT news_id, {TYPE_CASE} AS t, ((news_id // 10000) % 600)::DOUBLE AS age, news_id % 3 = 0 AS brk FROM v_headlines)
 SELECT news_id, t AS event_type, CASE WHEN brk AND age <= 10 THEN 1.0 ELSE round(greatest(pow(2.0, -age / {HALF}), 0.05), 3) END AS timeliness FROM n""", "v_headlines"))
def timeliness_factors(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    age = F.expr("news_id div 10000") % 600  # as a double the id would lose its last digits
    published = F.timestamp_seconds(F.unix_timestamp(V.ts(V.AS_OF)) - age * 60)
    kind = C.event_type(F.lit(""), t, F.lit(None).cast("string"))
    return h.select("news_id", kind.alias("event_type"), C.timeliness(published, F.col("news_id") % 3 == 0, kind, V.ts(V.AS_OF)).alias("timeliness"))


@query(sql(f"""SELECT news_id, greatest(CASE WHEN news_id % 4 = 0 THEN 0.8 + least(1 * 0.3, 0.7) ELSE 0 END, CASE WHEN news_id % 4 = 1 THEN 0.5 + least(1 * 0.2, 0.4) ELSE 0 END, CASE WHEN {any_sql(LOW, S.MACRO_WORDS)} THEN 0.6 ELSE 0 END)::DOUBLE AS protective FROM v_headlines""", "v_headlines"))
def protective_scores(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    mine = F.array(F.element_at(F.array(*[F.lit(x) for x in ("AAA", "BBB", "CCC", "DDD")]), (F.col("news_id") % 4 + 1).cast("int")))
    return h.select("news_id", F.round(C.protective_score(mine, t, F.lit(None).cast("string"), ["AAA"], ["AAA", "BBB"]), 4).alias("protective"))


def count_sql(c: str, words) -> str:
    return "(" + " + ".join(f"contains({c}, {q(w)})::INT" for w in words) + ")"


PENALTY = f"""least(CASE WHEN {rx_sql(LOW, S.RETROSPECTIVE_PATTERNS, '')} THEN 0.5 ELSE 1 END, CASE WHEN {rx_sql(LOW, S.THREAT_PATTERNS, '')} THEN 0.65 ELSE 1 END,
 CASE WHEN {rx_sql(LOW, [S.PERSONNEL_PATTERN], '')} AND NOT {rx_sql(LOW, [S.POLICY_PATTERN], '')} THEN 0.55 ELSE 1 END)"""
TAG_TYPE = "CASE " + " ".join(f"WHEN contains(tags, {q(k)}) THEN {q(v)}" for k, v in S.TAG_EVENT_TYPES.items()) + " END"
MATCH_TYPE = "CASE best " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in S.STRATEGIC_EVENT_TYPES.items()) + " END"
MATCH_WORTH = "CASE category " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in S.OPPORTUNITY_CATEGORIES.items()) + " ELSE 0.5 END"
OTHERS = "[" + ", ".join(q(w) for w in E.DEFAULT_WATCHLIST if w != "NVDA") + "]"


@query(sql(f"""WITH RECURSIVE {strategic_ctes('SELECT news_id AS id, title FROM v_headlines')},
 best AS (SELECT id, arg_min(category, seq - 10 * conf) AS best, max({MATCH_WORTH} * conf) AS worth FROM strategic GROUP BY id),
 n AS (SELECT h.*, {TICKERS} AS tk, lower(array_to_string({MACRO_FOUND}, ',')) AS tags, best, coalesce(worth, 0) AS worth, {rx_sql('title', D.BREAKING_MARKERS)} AS brk
  FROM v_headlines h LEFT JOIN best ON h.news_id = best.id),
 r AS (SELECT *, CASE WHEN title = '' THEN 0.85 WHEN brk THEN 1.0 WHEN {count_sql(LOW, S.SHOCK_WORDS)} >= 2 THEN 1.0 WHEN {count_sql(LOW, S.SHOCK_WORDS)} = 1 THEN 0.9
  WHEN {count_sql(LOW, S.NOVELTY_WORDS)} >= 2 THEN 0.85 END AS rule FROM n),
 f AS (SELECT news_id, row_number() OVER (PARTITION BY title ORDER BY captured_at, news_id) AS k FROM r WHERE rule IS NULL),
 w AS (SELECT *, list_filter(string_split_regex(replace(tags, ',', ' '), '\\s+'), lambda x: x <> '') AS words FROM r),
 s AS (SELECT w.*, coalesce(rule, CASE WHEN f.k = 1 THEN 0.85 ELSE 0.1 END)::DOUBLE AS novelty, coalesce({MATCH_TYPE}, {TAG_TYPE}, {TYPE_CASE}) AS event_type,
  greatest(CASE WHEN list_contains(tk, 'NVDA') THEN 1.1 ELSE 0 END, CASE WHEN len(list_intersect(tk, {OTHERS})) > 0 THEN 0.5 + least(len(list_intersect(tk, {OTHERS})) * 0.2, 0.4) ELSE 0 END,
   CASE WHEN {any_sql("(lower(title) || ' ' || tags)", S.MACRO_WORDS)} THEN 0.6 ELSE 0 END)::DOUBLE AS protective,
  greatest(worth, {max_sql('tags', S.HIGH_IMPACT_TAGS)})::DOUBLE AS first FROM w LEFT JOIN f ON f.news_id = w.news_id),
 o AS (SELECT *, least(greatest(CASE WHEN len(words) > 0 AND len(list_filter(words, lambda x: NOT list_contains([{', '.join(q(t) for t in S.LOW_IMPACT_TAGS)}], x))) = 0 THEN least(first, 0.5) ELSE first END,
  {max_sql(LOW, S.SECTOR_SIGNALS)}) * {PENALTY}, 1.5)::DOUBLE AS opportunity FROM s),
 z AS (SELECT *, CASE WHEN greatest(protective, opportunity) = 0 THEN 0.3 ELSE greatest(protective, opportunity) END AS relevance FROM o)
 SELECT news_id, event_type, 1.0::DOUBLE AS timeliness, novelty, relevance, CASE WHEN protective >= opportunity AND protective > 0 THEN 'protective' WHEN opportunity > protective THEN 'opportunity' ELSE 'none' END AS direction,
  round(novelty * relevance, 3) AS composite FROM z""", "v_headlines"))
def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")

    def work(h: DataFrame) -> DataFrame:
        h = T.once(h.withColumn("text", t), tickers=G.extract_tickers(t), macro_tags=G.tag_words(t, E.MACRO_ALERTS),
                   strategic=Z.strategic_matches(t), is_breaking=T.is_breaking(t))
        h = h.withColumn("novelty_rule", W.novelty_rule(t, F.col("is_breaking")))
        # the novelty reads the titles twice; without this their rules would run twice
        return checkpoint(C.relevance_parts(h, ["NVDA"], E.DEFAULT_WATCHLIST).drop("title", "tickers", "macro_tags", "strategic"))

    n = per_title(spark, d, work, also=["captured_at"]).withColumn("published_at", F.lit(None).cast("timestamp"))
    s = C.signal_score(n, V.ts(V.AS_OF), ["NVDA"], E.DEFAULT_WATCHLIST)
    return s.select("news_id", "event_type", "timeliness", "novelty", "relevance", "direction", "composite")


@query(sql("""SELECT news_id, greatest(0, least(10, 5 + CASE WHEN lang = 'en' THEN 3 ELSE 0 END + CASE WHEN contains(lower(snippet), 'thing') THEN 2 ELSE 0 END - CASE WHEN contains(lower(snippet), 'ich ') THEN 3 ELSE 0 END
 - CASE WHEN contains(lower(snippet), 'the')::INT + contains(lower(snippet), 'and')::INT + contains(lower(snippet), 'tion')::INT + contains(lower(snippet), 'heat')::INT >= 3 THEN 3 ELSE 0 END)) AS relevance FROM v_news""", "v_news"))
def personal_relevance(spark: SparkSession, d: str) -> DataFrame:
    p = C.personal_relevance(F.col("snippet"), F.array(F.upper("lang")), ["EN"], ["thing"], ["ich "], ["the and of tion", "heat"])
    return V.news(spark, d).select("news_id", p["score"].alias("relevance"))


def mood_sql(source: str) -> str:
    """CTEs that end in ``mood`` (id, v): the sum of valences with negations and boosters in the three words before; ``source`` gives id and text."""
    boost = "CASE {w} " + " ".join(f"WHEN {q(w)} THEN {v}" for w, v in S.BOOSTERS.items()) + " ELSE 0 END"
    listed = "CASE {w} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in S.SENTIMENT_VALENCE.items()) + " END"
    negated = "(list_contains([" + ", ".join(q(w) for w in S.NEGATIONS) + "], {w}) OR {w} LIKE '%n''t')"
    steps, last = [], "h0"
    for k, share in enumerate(S.BOOSTER_SHARES, start=1):
        w = f"w[i - {k}]"
        open_ = f"i > {k} AND {listed.format(w=w)} IS NULL"
        steps.append(f"""h{k} AS (SELECT id, i, w, CASE WHEN {open_} THEN (v + sign(v) * ({boost.format(w=w)}) * {share}) * CASE WHEN {negated.format(w=w)} THEN {S.NEGATION_FACTOR} ELSE 1 END ELSE v END AS v FROM {last})""")
        last = f"h{k}"
    return f"""tokens AS (SELECT id, list_transform(string_split_regex(regexp_replace(lower(text), '[^a-z''\\-\\s]', ' ', 'g'), '\\s+'), lambda x: trim(x, chr(39))) AS w FROM ({source})),
 h0 AS (SELECT id, i, w, ({listed.format(w='w[i]')})::DOUBLE AS v FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM tokens) WHERE {listed.format(w='w[i]')} IS NOT NULL),
 {', '.join(steps)},
 mood AS (SELECT t.id, coalesce(sum(v), 0)::DOUBLE AS v FROM tokens t LEFT JOIN {last} h ON h.id = t.id GROUP BY t.id)"""


CLASS_SQL = """CASE WHEN {m} >= 0.15 THEN 'bullish' WHEN {m} >= 0.05 THEN 'cautiously_bullish' WHEN {m} > -0.05 THEN 'neutral' WHEN {m} > -0.15 THEN 'cautiously_bearish' ELSE 'bearish' END"""


@query(sql(f"""WITH {mood_sql('SELECT news_id AS id, title AS text FROM v_headlines')}
 SELECT id AS news_id, round(v / sqrt(v * v + 15), 4) AS sentiment_score, {CLASS_SQL.format(m='v / sqrt(v * v + 15)')} AS sentiment FROM mood""", "v_headlines"))
def lexicon_sentiment(spark: SparkSession, d: str) -> DataFrame:
    s = A.lexicon_sentiment(V.headlines(spark, d), id_col="news_id", text="title")
    return s.select("news_id", "sentiment_score", T.sentiment_class(F.col("sentiment_score")).alias("sentiment"))


SPOKEN = ["surge", "not surge", "do not ever surge", "very sharply surge", "isn't slightly a surge", "hardly, really, 'surge'", "never so badly crash", "crash surge"]
SPOKEN_SQL = "SELECT news_id AS id, replace(title, 'surge', ([" + ", ".join(q(w) for w in SPOKEN) + f"])[news_id % {len(SPOKEN)} + 1]) AS text FROM v_headlines"


@query(sql(f"""WITH {mood_sql(SPOKEN_SQL)}
 SELECT id AS news_id, round(v / sqrt(v * v + 15), 4) AS sentiment_score FROM mood""", "v_headlines"))
def contextual_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Headlines whose strongest word is negated, boosted or both."""
    said = F.element_at(F.array(*[F.lit(w) for w in SPOKEN]), (F.col("news_id") % len(SPOKEN) + 1).cast("int"))
    h = V.headlines(spark, d).withColumn("text", F.replace("title", F.lit("surge"), said))
    return A.lexicon_sentiment(h, id_col="news_id").select("news_id", "sentiment_score")


@query(sql(f"""WITH b AS (SELECT news_id, title || ' ' AS title, title AS headline, source FROM v_headlines),
 {mood_sql('SELECT news_id AS id, title AS text FROM b')},
 n AS (SELECT b.*, v / sqrt(v * v + 15) AS mood, len({TICKERS}) AS nt, len({MACRO_FOUND}) AS nm,
  CASE WHEN headline LIKE 'CPI rose%' THEN abs(CAST(regexp_extract(headline, 'rose (\\d+)%', 1) AS DOUBLE) - 20) / 20
  WHEN headline LIKE 'BREAKING: factory%' THEN abs(CAST(regexp_extract(headline, 'orders (\\d+)K', 1) AS DOUBLE) - 25) / 25 END AS x FROM b JOIN mood ON mood.id = b.news_id),
 s AS (SELECT *, round({RAW_SCORE.replace('N_TAGS', 'nm').replace('N_TICKERS', 'nt')}, 4)::DOUBLE AS p FROM n)
 SELECT news_id, CASE WHEN mood >= 0.15 THEN 'bullish' WHEN mood >= 0.05 THEN 'cautiously_bullish' WHEN mood > -0.05 THEN 'neutral' WHEN mood > -0.15 THEN 'cautiously_bearish' ELSE 'bearish' END AS sentiment,
  p AS priority_score, CASE WHEN p >= 0.7 OR nt >= 3 THEN 'high' WHEN p >= 0.4 OR nt >= 1 THEN 'medium' ELSE 'low' END AS market_impact,
  CASE WHEN p >= 0.7 THEN 'deep_pushed' WHEN p >= 0.4 THEN 'fast_pushed' ELSE 'archived' END AS status FROM s""", "v_headlines"))
def deep_enrichment(spark: SparkSession, d: str) -> DataFrame:
    e = C.enrich_deep(V.headlines(spark, d))
    return e.select("news_id", "sentiment", "priority_score", "market_impact", "status")


def bound_sql(value: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {bound} THEN {weight}" for bound, weight in bounds) + " ELSE 0 END"


CASE_WORDS = {name: words for name, words, _, _ in D.CASE_TERMS}
CASE_SUM = " + ".join(f"CASE WHEN {any_sql(LOW, words)}" + "".join(f" AND NOT {any_sql(LOW, CASE_WORDS[other])}" for other in unless) + f" THEN {weight} ELSE 0 END"
                      for _, words, weight, unless in D.CASE_TERMS)
CASE_MENTIONS = f"len(regexp_extract_all(title, '(?i){'|'.join(D.CASE_COMPANIES)}'))"


@query(sql(f"""SELECT news_id, least({D.CASE_CAP}, round({D.CASE_BASE} + {CASE_SUM}
 + coalesce(list_sum(list_transform(regexp_extract_all(title, {q(D.CASE_AMOUNT)}, 1), lambda x: {bound_sql('CAST(x AS INT)', D.CASE_AMOUNT_BOUNDS)})), 0)
 + {bound_sql(CASE_MENTIONS, D.CASE_COMPANY_BOUNDS)}, 2))::DOUBLE AS priority FROM v_headlines""", "v_headlines"))
def case_priorities(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    return h.select("news_id", C.case_priority(t).alias("priority"))


# --- decisions ------------------------------------------------------------------------------------
@query(sql("""WITH a AS (SELECT *, (['FLASH', 'ALERT', 'WATCH', 'INFO', ''])[id % 5 + 1] AS urgency, (id % 10) / 10.0 AS rel, id % 7 = 0 AS no_assess, id % 2 = 0 AS has_t, id % 3 = 0 AS macro, ((id * 13) % 100) / 100.0 AS score FROM v_assess),
 b AS (SELECT *, round((impact_score * 0.7 + (id % 100) * 0.3) * rel::DOUBLE, 1) AS comp FROM a),
 c AS (SELECT *, CASE WHEN no_assess THEN CASE WHEN score >= 0.55 THEN 'critical' WHEN score >= CASE WHEN rel > 0.5 THEN 0.35 ELSE 0.5 END THEN 'important' ELSE 'normal' END
 WHEN urgency = 'FLASH' THEN 'critical' WHEN urgency = 'ALERT' THEN 'important' WHEN urgency IN ('WATCH', 'INFO') THEN 'normal' WHEN comp >= 55 THEN 'critical' WHEN comp >= 50 THEN 'important' ELSE 'normal' END AS base FROM b)
 SELECT id, CASE WHEN has_t AND NOT macro AND rel <= 0.5 THEN 'normal' ELSE base END AS level FROM c""", "v_assess"))
def classified_alerts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    a = V.assessments(spark, d)
    gone = k % 7 == 0
    df = a.select("id", F.when(~gone, F.col("impact_score")).alias("impact_score"), (k % 100).cast("double").alias("confidence"),
                  F.element_at(F.array(*[F.lit(x) for x in ("FLASH", "ALERT", "WATCH", "INFO", "")]), (k % 5 + 1).cast("int")).alias("urgency"),
                  F.array().cast(Z.MATCH).alias("strategic"), (k % 10 / 10).alias("rel_mult"), F.lit(0.1).alias("timeliness"),
                  (k % 2 == 0).alias("has_tickers"), (k % 3 == 0).alias("is_macro"), F.lit(False).alias("is_breaking"), ((k * 13) % 100 / 100).alias("priority_score"))
    return X.classify_alert(df).select("id", "level")


CHANNEL = """CASE WHEN i < 3 THEN 'normal' WHEN i = 3 THEN 'notable' WHEN opinion THEN CASE WHEN i >= 5 THEN 'critical' ELSE 'notable' END
 WHEN dir = 'down' THEN CASE WHEN NOT conf THEN 'notable' WHEN held THEN 'critical' ELSE 'important' END WHEN dir = 'up' THEN CASE WHEN i >= 5 THEN 'critical' ELSE 'important' END ELSE 'important' END"""


@query(sql(f"""WITH b AS (SELECT id, id % 5 + 1 AS i0, (['up', 'down', 'neutral'])[id % 3 + 1] AS dir, id % 2 = 0 AS conf, id % 4 = 0 AS held, id % 5 = 2 AS opinion, (['immediate', 'recent', 'retrospective_new', 'retrospective'])[news_id % 4 + 1] AS tl, news_id % 6 AS src, (news_id % 120)::DOUBLE AS age FROM v_assess),
 c AS (SELECT *, least(i0, CASE tl WHEN 'retrospective' THEN 2 WHEN 'retrospective_new' THEN 3 ELSE 99 END) AS cap FROM b), e AS (SELECT *, CASE WHEN src >= 3 AND cap < 5 THEN cap + 1 ELSE cap END AS i FROM c), l AS (SELECT *, {CHANNEL} AS lvl FROM e)
 SELECT id, i AS final_intensity, CASE WHEN lvl = 'important' AND src < 3 AND age > 60 THEN 'notable' ELSE lvl END AS alert_level FROM l""", "v_assess"))
def event_decisions(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("id"), F.col("news_id")

    def pick(options, index):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))

    df = V.assessments(spark, d).select(
        "id", (k % 5 + 1).cast("int").alias("intensity"), pick(("up", "down", "neutral"), k % 3).alias("direction"), (k % 2 == 0).alias("confirmed"),
        F.when(k % 4 == 0, F.array(F.lit(" nvda"))).otherwise(F.array(F.lit("ZZZ"))).alias("tickers"), F.when(k % 5 == 2, F.array(F.lit(3))).otherwise(F.array(F.lit(1), F.lit(3))).alias("event_types"),
        pick(("immediate", "recent", "retrospective_new", "retrospective"), n % 4).alias("timeliness"), (n % 6).alias("source_count"), (n % 120).cast("double").alias("age_minutes"))
    return X.apply_event_decision(df, ["NVDA"]).select("id", "final_intensity", "alert_level")


@query(sql("SELECT id, CASE WHEN id % 3 = 0 AND id % 4 = 0 OR CAST(trunc(impact_score) AS INT) >= 80 THEN 'notable' ELSE 'normal' END AS alert_level, trunc(impact_score) >= 60 OR id % 5 = 0 AS needs_deep FROM v_assess", "v_assess"))
def rescued_alerts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    df = V.assessments(spark, d).select("id", "impact_score", F.lit(False).alias("is_event"), (k % 3 == 0).alias("notable"),
                                        F.when(k % 4 == 0, F.array(F.lit("nvda "))).otherwise(F.array(F.lit("ZZZ"))).alias("tickers"), F.when(k % 5 == 0, "FLASH").otherwise("INFO").alias("urgency"))
    return X.rescue_level(df, ["NVDA"]).select("id", "alert_level", "needs_deep")


@query(sql("""SELECT id, CASE id % 3 WHEN 0 THEN CASE news_id % 3 WHEN 0 THEN 'notable' ELSE 'important' END WHEN 1 THEN CASE news_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'notable' ELSE 'important' END
 ELSE CASE news_id % 3 WHEN 2 THEN 'notable' ELSE 'normal' END END AS level FROM v_assess""", "v_assess"))
def macro_levels(spark: SparkSession, d: str) -> DataFrame:
    tier = F.element_at(F.array(*[F.lit(x) for x in "ABC"]), (F.col("id") % 3 + 1).cast("int"))
    dev = F.element_at(F.array(*[F.lit(x) for x in ("slight", "significant", "extreme")]), (F.col("news_id") % 3 + 1).cast("int"))
    return V.assessments(spark, d).select("id", X.macro_level(tier, dev).alias("level"))


@query(sql("""WITH a AS (SELECT id, (['normal', 'notable', 'important', 'critical'])[id % 4 + 1] AS lvl, news_id % 6 AS n, news_id % 5 = 0 AS missing FROM v_assess)
 SELECT id, CASE WHEN lvl = 'normal' OR missing THEN lvl WHEN n >= 3 THEN 'normal' WHEN n >= 2 THEN 'notable' ELSE lvl END AS reviewed_level FROM a""", "v_assess"))
def reviewed_alerts(spark: SparkSession, d: str) -> DataFrame:
    lvl = F.element_at(F.array(*[F.lit(x) for x in ("normal", "notable", "important", "critical")]), (F.col("id") % 4 + 1).cast("int"))
    n = (F.col("news_id") % 6).cast("int")
    fails = F.when(F.col("news_id") % 5 != 0, F.slice(F.array(*[F.lit(i) for i in range(1, 6)]), 1, n))
    return X.apply_review(V.assessments(spark, d).select("id", lvl.alias("alert_level"), fails.alias("failures"))).select("id", "reviewed_level")


@query(sql("""SELECT id, CASE WHEN id % 4 = 2 THEN news_id % 3 = 0 OR (news_id % 3 = 1 AND CAST(trunc(impact_score) AS INT) >= 92) ELSE id % 4 = 3 END AS phone FROM v_assess""", "v_assess"))
def phone_gate(spark: SparkSession, d: str) -> DataFrame:
    lvl = F.element_at(F.array(*[F.lit(x) for x in ("normal", "notable", "important", "critical")]), (F.col("id") % 4 + 1).cast("int"))
    tags = F.when(F.col("news_id") % 3 == 0, F.array(F.lit("CPI"), F.lit("STRATEGIC_GOV"))).when(F.col("news_id") % 3 == 1, F.array(F.lit("CPI"))).otherwise(F.array().cast("array<string>"))
    return V.assessments(spark, d).select("id", X.phone_gate(lvl, tags, F.col("impact_score").cast("int")).alias("phone"))


@query("""SELECT event_id, CASE WHEN w THEN 'weekend' WHEN m >= 1200 THEN 'overnight' WHEN m >= 960 THEN 'after-hours' WHEN m >= 570 THEN 'regular' WHEN m >= 240 THEN 'pre-market' ELSE 'overnight' END AS session FROM (
 SELECT event_id, hour(e) * 60 + minute(e) AS m, dayofweek(e) IN (0, 6) AS w FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS e FROM events))""")
def market_sessions(spark: SparkSession, d: str) -> DataFrame:
    """January, so New York is five hours behind UTC."""
    e = V.read(spark, d, "events")
    return e.select("event_id", T.market_session(F.col("ts").cast("timestamp")).alias("session"))


@query("""SELECT o_orderkey, dayofweek(o_orderdate) NOT IN (0, 6) AS trading, CAST(o_orderdate AS DATE) + CASE dayofweek(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_day FROM orders""")
def trading_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return V.read(spark, d, "orders").select("o_orderkey", T.is_trading_day(day).alias("trading"), T.next_trading_day(day).alias("next_day"))


@query("""SELECT ps AS s_suppkey, CASE WHEN length(c) = 5 THEN 'HK.' ELSE 'US.' END || c AS symbol FROM (SELECT s_suppkey AS ps, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '0') ELSE 'T' || CAST(s_suppkey AS VARCHAR) END AS c FROM supplier) WHERE c LIKE 'T%' OR length(c) = 5""")
def symbol_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    code = F.when(k % 2 == 0, F.lpad(k.cast("string"), 5, "0")).otherwise(F.concat(F.lit("T"), k.cast("string")))
    s = V.read(spark, d, "supplier").select("s_suppkey", code.alias("c"))
    # 'T1234' has five characters but is not numeric
    return s.select("s_suppkey", T.symbol_code(F.col("c")).alias("symbol"))


# --- feed shapes ----------------------------------------------------------------------------------
@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS inner_,
 generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) - 1 AS pos FROM pages),
 r AS (SELECT page_id, pos, trim(regexp_replace(inner_, '<[^>]+>', '', 'g')) AS title, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE href END AS href FROM a),
 f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS k FROM r WHERE length(title) >= 4)
 SELECT page_id, pos, title, href FROM f WHERE k = 1""")
def page_headlines(spark: SparkSession, d: str) -> DataFrame:
    return feeds.extract_headlines(V.urls(spark, d), min_chars=4)


@query("""SELECT conv_id, turn, CASE WHEN length(b) <= 200 THEN b ELSE substr(b, 1, 197) || '...' END AS title, b AS snippet, 'Twitter @' || role AS source FROM (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS b FROM conversations) WHERE length(b) >= 10""")
def post_news(spark: SparkSession, d: str) -> DataFrame:
    c = V.read(spark, d, "conversations").select("conv_id", "turn", "text", F.col("role").alias("username"), F.lit("u").alias("url"))
    return feeds.read_posts(c).select("conv_id", "turn", "title", "snippet", "source")


def _bodies(spark: SparkSession, d: str, entry, wrap) -> DataFrame:
    """One JSON response per article with seven entries each."""
    n = V.news(spark, d)
    entries = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: entry(i))
    return n.select("news_id", "source", "lang", F.to_json(wrap(entries)).alias("body"))


@query(sql("""SELECT source, news_id * 10 + i AS article_id, 'H' || i || ' ' || news_id AS title, 'Finnhub (' || lang || ')' AS feed FROM v_news, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i) WHERE (news_id * 10 + i) % 3 <> 0 AND i <> 2""", "v_news"))
def company_news(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("news_id")
    b = _bodies(spark, d, lambda i: F.struct((k * 10 + i).alias("id"), F.when(i != 2, F.concat(F.lit("H"), i.cast("string"), F.lit(" "), k.cast("string"))).otherwise("").alias("headline"),
                                              F.lit("u").alias("url"), F.col("lang").alias("source"), F.lit("s").alias("summary"), F.lit(0).alias("datetime")), lambda e: e)
    seen = V.news(spark, d).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: k * 10 + i)).alias("id")).filter("id % 3 = 0")
    out = feeds.read_company_news(b.withColumnRenamed("source", "ticker"), V.ts(V.AS_OF), seen)
    return out.select(F.get("tickers", F.lit(0)).alias("source"), "article_id", "title", F.col("source").alias("feed"))


@query(sql("""SELECT 'Head ' || news_id || '.' || i AS title, '新浪财经·' || lang AS source, '【Head ' || news_id || '.' || i || '】' || coalesce(nullif(trim(substr('b' || news_id, 1, 480)), ''), '') AS snippet FROM v_news, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i) WHERE i <> 3""", "v_news"))
def live_text_news(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("news_id").cast("string")
    b = _bodies(spark, d, lambda i: F.struct(F.when(i == 3, F.lit("【涨停】x")).otherwise(F.concat(F.lit("<b>【Head "), k, F.lit("."), i.cast("string"), F.lit("】</b>b"), k)).alias("rich_text"),
                                              F.lit("2024-01-01 00:00:00").alias("create_time"), F.lit("u").alias("docurl")),
                lambda e: F.struct(F.struct(F.struct(F.struct(e.alias("list")).alias("feed")).alias("data")).alias("result")))
    return feeds.read_zhibo(b.withColumn("channel", F.col("lang")), V.ts(V.AS_OF)).select("title", "source", "snippet")


@query(sql("""SELECT 'https://wallstreetcn.com/live/global/' || (news_id * 10 + i) AS url, 'T' || i AS title, 'A' || news_id || ',B' AS tickers FROM v_news, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i) WHERE news_id % 5 <> 0""", "v_news"))
def live_channel_news(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("news_id")
    sym = lambda: F.array(F.to_json(F.struct(F.concat(F.lit("A"), k.cast("string")).alias("symbol"))), F.lit("B"))
    b = _bodies(spark, d, lambda i: F.struct((k * 10 + i).alias("id"), F.concat(F.lit("T"), i.cast("string")).alias("title"), F.lit("<p>x</p>").alias("content_text"),
                                              F.lit(1704067200).alias("display_time"), sym().alias("symbols")),
                lambda e: F.struct(F.when(k % 5 == 0, 50000).otherwise(20000).alias("code"), F.struct(e.alias("items")).alias("data")))
    return feeds.read_live_channel(b.withColumn("channel", F.col("lang")), V.ts(V.AS_OF)).select("url", "title", F.array_join("tickers", ",").alias("tickers"))


@query(sql("""SELECT url, sentiment FROM (SELECT 'u' || (news_id * 7 + i) % 3000 AS url, (['bullish', 'bearish', ''])[CAST((news_id + i) % 3 AS INT) + 1] AS sentiment, row_number() OVER (PARTITION BY (news_id * 7 + i) % 3000 ORDER BY lpad(CAST(news_id AS VARCHAR), 9, '0'), i) AS rn FROM v_news, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i)) WHERE rn = 1""", "v_news"))
def sentiment_feed_news(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("news_id")
    b = _bodies(spark, d, lambda i: F.struct(F.lit("t").alias("title"), F.concat(F.lit("u"), ((k * 7 + i) % 3000).cast("string")).alias("url"), F.lit("s").alias("source"), F.lit("m").alias("summary"),
                                              F.element_at(F.array(F.lit("Bullish"), F.lit("Bearish"), F.lit("Neutral")), ((k + i) % 3 + 1).cast("int")).alias("overall_sentiment_label")),
                lambda e: F.struct(e.alias("feed")))
    return feeds.read_sentiment_feed(b.withColumn("ticker", F.lpad(k.cast("string"), 9, "0"))).select("url", "sentiment")


@query("""SELECT p_partkey, '[' || t || '] ' || n || ' — released 2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS title FROM (SELECT p_partkey, (['Consumer Price Index', 'FOMC Press Release', 'Weekly Survey', 'Retail Sales'])[p_partkey % 4 + 1] AS n, (['CPI', 'FOMC', NULL, 'Retail'])[p_partkey % 4 + 1] AS t FROM part) WHERE t IS NOT NULL""")
def release_calendar_news(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rel = V.read(spark, d, "part").select(k.alias("release_id"), F.element_at(F.array(*[F.lit(x) for x in ("Consumer Price Index", "FOMC Press Release", "Weekly Survey", "Retail Sales")]), (k % 4 + 1).cast("int")).alias("release_name"),
                                          F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("date"))
    out = feeds.read_release_calendar(rel)
    return out.select(F.regexp_extract("url", r"rid=(\d+)", 1).cast("bigint").alias("p_partkey"), "title")


@query("""SELECT title, tickers FROM (SELECT '8-K - ' || s_name || ' NVDA (CIK ' || s_suppkey || ')' AS title, 'NVDA' AS tickers, s_suppkey FROM supplier) WHERE s_suppkey % 2 = 0""")
def filings_news(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    e = V.read(spark, d, "supplier").select(F.col("s_nationkey").alias("document"), k.alias("position"), F.concat(F.lit("8-K - "), "s_name", F.when(k % 2 == 0, " NVDA").otherwise(" XX"), F.lit(" (CIK "), k.cast("string"), F.lit(")")).alias("title"),
                                            F.lit("l").alias("link"), F.lit("u").alias("updated"))
    return feeds.read_filings(e, ["NVDA", "TSLA"]).select(F.regexp_replace("title", "^SEC 8-K Filing: ", "").alias("title"), F.array_join("tickers", ",").alias("tickers"))


@query(sql("SELECT news_id, CASE WHEN news_id % 2 = 0 THEN 'R' || news_id WHEN lang = 'de' THEN '' ELSE upper(lang) || 'T' END AS tickers FROM v_news", "v_news"))
def search_news(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("news_id")
    n = V.news(spark, d)
    rows = n.select(k.cast("string").alias("title"), "url", "source", F.lit("2024-01-01 00:00:00").alias("publish_time"),
                    F.when(k % 2 == 0, F.array(F.concat(F.lit("R"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("related"), F.col("lang").alias("search_kw"))
    kw = n.filter("lang <> 'de'").select(F.col("lang").alias("keyword"), F.concat(F.upper("lang"), F.lit("T")).alias("ticker")).distinct()
    return feeds.read_search_news(rows, kw).select(F.col("title").cast("bigint").alias("news_id"), F.array_join("tickers", ",").alias("tickers"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS main_net, l_quantity AS super_net, (['NASDAQ', 'NYSE', 'MKT104'])[l_linenumber % 3 + 1] AS market FROM lineitem WHERE l_linenumber <> 4")
def flow_klines(spark: SparkSession, d: str) -> DataFrame:
    li = V.read(spark, d, "lineitem")
    q_, e = F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")
    line = F.concat_ws(",", F.date_format("l_shipdate", "yyyy-MM-dd"), e, q_, q_, q_, q_, F.when(F.col("l_linenumber") == 4, "bad").otherwise("1.5"))
    num = F.element_at(F.array(F.lit(105), F.lit(106), F.lit(104)), F.col("l_linenumber") % 3 + 1)
    raw = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"), num.alias("market_number"))
    return flows.parse_flow_klines(raw).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date", "main_net", "super_net", "market")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ticker, DATE '2024-01-01' + i AS date, s_acctbal AS main_net, 22.0 + i AS change_pct FROM supplier, (SELECT unnest([3, 4, 5]) AS i)""")
def flow_arrays(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = lambda i: F.concat_ws(",", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), i), "yyyy-MM-dd"), F.lit("1"), F.lit("2"), F.col("s_acctbal").cast("string"), *[F.lit(str(j)) for j in range(4, 22)], (i + 22).cast("string"))
    docs = V.read(spark, d, "supplier").select(k.cast("string").alias("ticker"), F.concat(F.lit("("), F.to_json(F.transform(F.sequence(F.lit(0), F.lit(5)), line)), F.lit(");")).alias("body"))
    return flows.parse_flow_array(docs, 3).select("ticker", "date", "main_net", "change_pct")


@query("""SELECT item_id, (['monetary', 'corporate', 'regulatory'])[item_id % 3 + 1] AS category, n AS event_no, (['CRITICAL', 'LOW'])[n] AS level, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark, (SELECT unnest([1, 2]) AS n)""")
def event_corpora(spark: SparkSession, d: str) -> DataFrame:
    b = V.read(spark, d, "benchmark")
    head = F.element_at(F.array(F.lit("一、货币政策"), F.lit("二、科技"), F.lit("三、贸易政策")), (F.col("item_id") % 3 + 1).cast("int"))
    body = F.regexp_replace("text", r"\s+", " ")
    event = lambda n, lvl: F.concat(F.lit(f"### 1.{n} t\n- **日期**: 2026-01-0{n}\n- **事件**: "), body, F.lit(f"\n- **影响级别**: x {lvl}\n- **受影响标的**: SPY, QQQ\n- **分类标签**: `cpi`, `fed`\n"))
    doc = F.concat(F.lit("# title\n\n## "), head, F.lit("\n\n"), event(1, "CRITICAL"), event(2, "LOW"))
    out = flows.parse_event_corpus(b.select(F.col("item_id").alias("path"), doc.alias("value")))
    return out.select(F.col("path").alias("item_id"), "category", "event_no", "level", "text")


@query(sql("SELECT id, impact_score, id % 4 = 3 AS rejected, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 2 = 0 THEN 'FLASH' ELSE 'INFO' END AS urgency FROM v_assess WHERE id % 4 <> 3 UNION ALL SELECT id, NULL, true, NULL FROM v_assess WHERE id % 4 = 3", "v_assess"))
def impact_responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    obj = F.to_json(F.struct(F.col("impact_score"), F.when(k % 2 == 0, "flash").alias("urgency"), F.array(F.lit("a"), F.lit("b")).alias("reasoning_chain")))
    raw = F.when(k % 4 == 3, F.lit("sorry, no")).when(k % 4 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(obj)
    good, bad = responses.parse_impact_responses(V.assessments(spark, d).select("id", raw.alias("raw")))
    return good.select("id", "impact_score", F.lit(False).alias("rejected"), "urgency").unionByName(
        bad.select("id", F.lit(None).cast("double").alias("impact_score"), F.lit(True).alias("rejected"), F.lit(None).cast("string").alias("urgency")))


@query(sql("""SELECT id, id % 4 <> 3 AND id % 2 = 0 AS is_event, CASE WHEN id % 4 = 3 THEN 0 ELSE id % 5 + 1 END AS intensity, CASE WHEN id % 4 <> 3 AND id % 3 = 0 THEN 'retrospective' ELSE 'immediate' END AS timeliness,
 CASE WHEN id % 4 = 3 THEN '' ELSE '1,3' END AS event_types, CASE WHEN id % 4 = 3 THEN 'JSON parse error' ELSE '' END AS filter_reason FROM v_assess""", "v_assess"))
def event_responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    obj = F.to_json(F.struct((k % 2 == 0).alias("is_event"), (k % 5 + 1).alias("intensity"), F.array(F.lit("1"), F.lit("x"), F.lit("3")).alias("event_types"),
                             F.when(k % 3 == 0, " Retrospective").otherwise("someday").alias("timeliness")))
    raw = F.when(k % 4 == 3, F.lit("{oops")).when(k % 4 == 1, F.concat(F.lit("```\n"), obj, F.lit("\n```"))).otherwise(obj)
    out = responses.parse_event_responses(V.assessments(spark, d).select("id", raw.alias("raw")))
    return out.select("id", "is_event", "intensity", "timeliness", F.array_join("event_types", ",").alias("event_types"), "filter_reason")


@query(sql("""SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE (['PUSH', 'SILENT', 'DROP'])[id % 3 + 1] END AS verdict, CASE WHEN id % 4 = 3 THEN NULL ELSE '1,5' END AS failures FROM v_assess""", "v_assess"))
def review_responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    obj = F.to_json(F.struct(F.element_at(F.array(F.lit("push"), F.lit("SILENT"), F.lit("Drop")), (k % 3 + 1).cast("int")).alias("verdict"), F.array(F.lit(1), F.lit(9), F.lit(5)).alias("failures"), F.lit("n").alias("note")))
    raw = F.when(k % 4 == 3, F.lit("no verdict here")).when(k % 4 == 1, F.concat(F.lit("I think "), obj, F.lit(" is right"))).otherwise(obj)
    out = responses.parse_review_responses(V.assessments(spark, d).select("id", raw.alias("raw")))
    return out.select("id", "verdict", F.array_join("failures", ",").alias("failures"))


@query(sql("SELECT id, id % 2 = 0 AS is_macro, CASE WHEN id % 2 = 0 THEN 'CPI' ELSE '' END AS indicator, CASE WHEN id % 2 = 0 THEN 'important' ELSE 'normal' END AS alert_level FROM v_assess WHERE id % 4 <> 3", "v_assess"))
def macro_responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    obj = F.to_json(F.struct((k % 2 == 0).alias("is_macro"), F.lit("CPI").alias("indicator"), F.lit("important").alias("alert_level")))
    good, _ = responses.parse_macro_responses(V.assessments(spark, d).select("id", F.when(k % 4 == 3, "bad").otherwise(obj).alias("raw")))
    return good.select("id", "is_macro", "indicator", "alert_level")


@query(sql("""SELECT id AS news_id, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS flags FROM v_assess""", "v_assess"))
def ungrounded_claims(spark: SparkSession, d: str) -> DataFrame:
    """Analyses with a known number of sentences the check has to flag."""
    k = F.col("id")
    a = V.assessments(spark, d).select(
        k.alias("news_id"),
        F.when(k % 4 == 0, "AAA今日下跌3%。若涨8%则止盈。").when(k % 4 == 1, "现价 99.5 元。AAA上涨。").when(k % 4 == 2, "目标价 120 元。建议买入。观望。").otherwise("AAA上涨。大盘下跌。").alias("analysis"),
        F.when(k % 4 == 2, F.array(F.lit("ZZZ"))).otherwise(F.array(F.lit("AAA"))).alias("tickers"))
    quotes = V.read(spark, d, "region").filter("r_regionkey = 0").select(F.lit("AAA").alias("ticker"), F.lit(101.25).alias("last"), F.lit(2.5).alias("change_pct"), F.lit(None).cast("double").alias("ma20"), F.lit(None).cast("double").alias("ma50"))
    _, flagged = U.flag_ungrounded_claims(a, quotes)
    n = flagged.groupBy("news_id").agg(F.count("*").alias("flags"))
    return a.select("news_id").join(n, "news_id", "left").select("news_id", F.coalesce("flags", F.lit(0)).alias("flags"))


# --- sets and sections ------------------------------------------------------------------------------
@query(sql("SELECT source, lang, status FROM v_news WHERE status = 'archived' UNION ALL SELECT source, lang, NULL FROM v_news WHERE status = 'pending'", "v_news"))
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    n = V.news(spark, d).select("source", "lang", "status")
    return R.union_sources([n.filter("status = 'archived'"), n.filter("status = 'pending'").drop("status")])


@query("SELECT DISTINCT upper(x) AS ticker FROM (SELECT p_brand AS x FROM part UNION ALL SELECT lower(c_mktsegment) FROM customer)")
def tracked_tickers(spark: SparkSession, d: str) -> DataFrame:
    watch = V.read(spark, d, "part").select(F.col("p_brand").alias("ticker"))
    held = V.read(spark, d, "customer").select(F.lower("c_mktsegment").alias("ticker"))
    return R.tracked_tickers(watch, held)


@query(sql("""SELECT id, array_to_string(list_sort(list_distinct(list_filter(['T' || id % 3, 'STRATEGIC_' || id % 2, '', 'T' || news_id % 3, 'STRATEGIC_' || news_id % 2], lambda x: x <> ''))), ',') AS merged,
 id % 2 = news_id % 2 AS same_strategy FROM v_assess""", "v_assess"))
def merged_tags(spark: SparkSession, d: str) -> DataFrame:
    def tags(c):
        return F.array(F.concat(F.lit("T"), (c % 3).cast("string")), F.concat(F.lit("STRATEGIC_"), (c % 2).cast("string")), F.lit(""))
    a, b = tags(F.col("id")), tags(F.col("news_id"))
    return V.assessments(spark, d).select("id", F.array_join(F.array_sort(R.merge_tags(a, b)), ",").alias("merged"), R.tag_overlap(a, b).alias("same_strategy"))


@query(sql("SELECT news_id, array_to_string(list_filter(['NVIDIA', 'AMD', 'FDA'], lambda k: contains(upper(title), k)), ',') AS tickers FROM v_headlines", "v_headlines"))
def mentioned_tickers(spark: SparkSession, d: str) -> DataFrame:
    h, t = title(spark, d)
    return h.select("news_id", F.array_join(G.mentioned_tickers(t, ["NVIDIA", "AMD", "FDA"]), ",").alias("tickers"))


@query(sql("SELECT news_id, news_id % 2 = 0 AS found, CASE WHEN news_id % 2 = 0 THEN 'advice ' || lpad(CAST(news_id AS VARCHAR), 12, '0') ELSE 'plain text number ' || lpad(CAST(news_id AS VARCHAR), 20, '0') END AS section FROM v_news", "v_news"))
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("news_id").cast("string")
    doc = F.when(F.col("news_id") % 2 == 0, F.concat(F.lit("top\n\n### Advice\n\nadvice "), F.lpad(k, 12, "0"), F.lit("\n\n### Risk\n\nnone"))).otherwise(
        F.concat(F.lit("# head\nplain text number "), F.lpad(k, 20, "0")))
    s = T.extract_section(doc, "Advice")
    return V.news(spark, d).select("news_id", s["found"].alias("found"), s["text"].alias("section"))


@query(sql("SELECT news_id, 'Item ' || news_id AS title, url, captured_at AS published_at FROM v_news", "v_news"))
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    """RSS items with times in five zones, landed as XML and read back; all name the same instants."""
    from ..runtime import shared_dir
    import uuid
    n = V.news(spark, d)
    k = F.col("news_id")
    hours = F.element_at(F.array(*[F.lit(h) for h in (0, -5, 2, -8, 0)]), (k % 5 + 1).cast("int"))
    zone = F.element_at(F.array(*[F.lit(z) for z in ("GMT", "-0500", "+0200", "PST", "Z")]), (k % 5 + 1).cast("int"))
    local = F.col("captured_at") + F.make_dt_interval(F.lit(0), hours)
    text = F.concat(F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss "), zone)
    path = f"{shared_dir(spark)}/rss-{uuid.uuid4().hex}"
    (n.select(F.concat(F.lit("Item "), k.cast("string")).alias("title"), F.col("url").alias("link"), F.lit("").alias("description"), text.alias("pubDate"))
     .write.format("xml").option("rowTag", "item").save(path))
    out = feeds.read_rss(spark, path, "feed", V.ts(V.AS_OF))
    return out.select(F.regexp_extract("title", r"(\d+)", 1).cast("bigint").alias("news_id"), "title", "url", "published_at")
