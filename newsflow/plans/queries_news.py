"""Queries over articles: duplicates, similarity, events, digests, sources, sinks' row logic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import views as V
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import cluster as C
from ..operators import dedup as D
from ..operators import ranking as R
from ..operators import similarity as S
from ..operators import tagging as G
from ..operators import windows as W
from ..runtime import shared_dir
from ..sinks import tables as K
from .registry import query
from .views import sql

NORM = "regexp_replace(regexp_replace(split_part({c}, '#', 1), '[?&](utm_\\w+|ref|source|fbclid|gclid)=[^&]*', '', 'g'), '[?&]$', '')"
PREFIX = "^(?:" + "|".join(m + e for m in ["BREAKING", "URGENT", "JUST IN", "FLASH", "ALERT", "DEVELOPING", "突发", "快讯", "重磅"]
                            for e in [":", "—", " -"]) + ")"
STRIP = f"CASE WHEN regexp_matches({{c}}, '{PREFIX}') THEN trim(regexp_replace({{c}}, '{PREFIX}', '')) ELSE {{c}} END"
TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> ''))"
AS_OF = f"TIMESTAMP '{V.AS_OF}'"


def norm(c: str) -> str:
    return NORM.format(c=c)


def strip_sql(c: str) -> str:
    return STRIP.format(c=c)


def tokens_sql(c: str) -> str:
    return TOKENS.format(c=c)


def jac(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"({inter}::DOUBLE / (len({a}) + len({b}) - {inter}))"


@query(sql(f"SELECT page_id, url, {norm('url')} AS normalized FROM pages"))
def normalize_urls(spark: SparkSession, d: str) -> DataFrame:
    return V.urls(spark, d).select("page_id", "url", T.normalize_url(F.col("url")).alias("normalized"))


@query(sql(f"SELECT news_id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY {norm('url')} ORDER BY captured_at, news_id) AS rn FROM v_news) WHERE rn = 1", "v_news"))
def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    return D.dedup_url(V.news(spark, d)).select("news_id", "title", "source")


@query(sql(f"""SELECT news_id FROM (SELECT *, row_number() OVER (PARTITION BY {norm('url')} ORDER BY captured_at, news_id) AS rn FROM v_news
 WHERE {norm('url')} NOT IN (SELECT {norm('url')} FROM v_news WHERE status = 'archived')) WHERE rn = 1""", "v_news"))
def url_dedup_against_seen(spark: SparkSession, d: str) -> DataFrame:
    n = V.news(spark, d)
    return D.dedup_url(n, n.filter("status = 'archived'")).select("news_id")


FINGERPRINT = f"sha256({strip_sql('title')} || '|' || snippet)"


@query(sql(f"SELECT news_id, {FINGERPRINT} AS fingerprint FROM v_news", "v_news"))
def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return V.news(spark, d).select("news_id", T.content_fingerprint(F.col("title"), F.col("snippet")).alias("fingerprint"))


@query(sql(f"SELECT news_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {FINGERPRINT} ORDER BY captured_at, news_id) AS rn FROM v_news) WHERE rn = 1", "v_news"))
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return D.dedup_exact(V.news(spark, d)).select("news_id", "source")


@query(sql(f"""SELECT source, count(*) AS articles, round(max(priority_score), 4) AS best_score FROM (
 SELECT *, row_number() OVER (PARTITION BY {FINGERPRINT} ORDER BY captured_at, news_id) AS rn FROM v_news) WHERE rn = 1 GROUP BY source""", "v_news"))
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    """Flagship slice: articles to fingerprints to first copies to counts per source."""
    return D.dedup_exact(V.news(spark, d)).groupBy("source").agg(
        F.count("*").alias("articles"), F.round(F.max("priority_score"), 4).alias("best_score"))


@query(sql(f"SELECT news_id, {strip_sql('title')} AS stripped FROM v_headlines", "v_headlines"))
def strip_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return V.headlines(spark, d).select("news_id", T.strip_prefix(F.col("title")).alias("stripped"))


@query(sql("SELECT news_id, trim(regexp_replace(title, '(?i)^(BREAKING|URGENT|ALERT|JUST IN|FLASH|DEVELOPING|EXCLUSIVE)\\s*[:-]?\\s*', '')) AS event_title FROM v_headlines", "v_headlines"))
def event_titles(spark: SparkSession, d: str) -> DataFrame:
    return V.headlines(spark, d).select("news_id", T.event_title(F.col("title")).alias("event_title"))


@query(sql(f"SELECT news_id, array_to_string(list_sort({tokens_sql('title')}), ' ') AS tokens FROM v_news", "v_news"))
def title_token_sets(spark: SparkSession, d: str) -> DataFrame:
    return V.news(spark, d).select("news_id", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("tokens"))


@query(sql("SELECT news_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]|[\\p{L}\\p{N}]'))), '') AS chars, len(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS latin FROM v_headlines", "v_headlines"))
def mixed_token_characters(spark: SparkSession, d: str) -> DataFrame:
    tok = T.mixed_tokens(F.col("title"))
    chars = F.array_distinct(F.flatten(F.transform(tok, lambda t: F.split(t, ""))))
    return V.headlines(spark, d).select(
        "news_id", F.array_join(F.array_sort(F.array_remove(chars, "")), "").alias("chars"),
        F.size(F.filter(tok, lambda t: t.rlike("^[a-z0-9]+$"))).alias("latin"))


@query(sql("SELECT page_id, length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS text_chars FROM pages"))
def clean_html_lengths(spark: SparkSession, d: str) -> DataFrame:
    return V.urls(spark, d).select("page_id", F.length(T.clean_html(F.col("html"))).alias("text_chars"))


@query(sql("""SELECT news_id, round(CASE WHEN length(regexp_replace(title, '[^\\p{L}]', '', 'g')) = 0 THEN 0 ELSE
 length(regexp_replace(title, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))::DOUBLE / length(regexp_replace(title, '[^\\p{L}]', '', 'g')) END, 4) AS ratio FROM v_headlines""", "v_headlines"))
def cjk_ratios(spark: SparkSession, d: str) -> DataFrame:
    return V.headlines(spark, d).select("news_id", F.round(T.cjk_ratio(F.col("title")), 4).alias("ratio"))


# --- near duplicates ----------------------------------------------------------------------------
STRIPPED_TOKENS = tokens_sql("(" + strip_sql("title") + ")")


@query(sql(f"""WITH t AS (SELECT list_sort({STRIPPED_TOKENS}) AS w, news_id FROM v_news),
 s AS (SELECT w, min(news_id) AS i, count(*) AS n FROM t WHERE len(w) > 0 GROUP BY w)
 SELECT least(a.i, b.i) AS keep_id, greatest(a.i, b.i) AS other_id, round({jac('a.w', 'b.w')}, 4) AS sim, a.n * b.n AS copies
 FROM s a JOIN s b ON a.i < b.i AND {jac('a.w', 'b.w')} >= 0.3""", "v_news"))
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.near_duplicate_pairs(V.news(spark, d), 0.3).withColumn("sim", F.round("sim", 4))


KEEP_FIRST = """WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY captured_at, news_id) AS rn, news_id, {cols} FROM v_news),
 pairs AS MATERIALIZED (SELECT a.rn AS x, b.rn AS y FROM t a JOIN t b ON a.rn < b.rn AND ({same})),
 hits AS MATERIALIZED (SELECT y, list(x) AS xs FROM pairs GROUP BY y),
 step(k, kept) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL
 SELECT s.k + 1, CASE WHEN h.y IS NULL OR NOT list_has_any(h.xs, s.kept) THEN list_append(s.kept, s.k + 1) ELSE s.kept END
 FROM step s LEFT JOIN hits h ON h.y = s.k + 1 WHERE s.k < (SELECT count(*) FROM t))
 SELECT news_id FROM t WHERE rn IN (SELECT unnest(kept) FROM step WHERE k = (SELECT count(*) FROM t))"""


@query(sql(KEEP_FIRST.format(cols=f"list_sort({STRIPPED_TOKENS}) AS w", same=f"len(a.w) > 0 AND len(b.w) > 0 AND {jac('a.w', 'b.w')} >= 0.3"), "v_news"))
def near_dup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return D.dedup_near(V.news(spark, d), 0.3).select("news_id")


@query(sql(KEEP_FIRST.format(
    cols=f"list_sort({STRIPPED_TOKENS}) AS w, {norm('url')} AS u, {FINGERPRINT} AS f",
    same=f"a.u = b.u OR a.f = b.f OR (len(a.w) > 0 AND len(b.w) > 0 AND {jac('a.w', 'b.w')} >= 0.65)"), "v_news"))
def batch_dedup(spark: SparkSession, d: str) -> DataFrame:
    return D.dedup_batch(V.news(spark, d), macro=F.lit(False)).select("news_id")


MACRO_KEEP = KEEP_FIRST.replace("WHEN h.y IS NULL OR NOT list_has_any(h.xs, s.kept)",
                                "WHEN h.y IS NULL OR NOT list_has_any(h.xs, s.kept) OR (SELECT m FROM t WHERE rn = s.k + 1)")


@query(sql(MACRO_KEEP.format(
    cols=f"list_sort({STRIPPED_TOKENS}) AS w, {norm('url')} AS u, {FINGERPRINT} AS f, lang = 'de' AS m",
    same=f"(NOT a.m AND NOT b.m AND (a.u = b.u OR a.f = b.f)) OR (len(a.w) > 0 AND len(b.w) > 0 AND {jac('a.w', 'b.w')} >= 0.65)"), "v_news"))
def batch_dedup_with_exempt_rows(spark: SparkSession, d: str) -> DataFrame:
    """One language plays the part of the exempt macro releases."""
    return D.dedup_batch(V.news(spark, d), macro=F.col("lang") == "de").select("news_id")


DOT = "list_dot_product({a}, {b})"
UNIT = "SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings"


@query(f"WITH e AS MATERIALIZED ({UNIT}) SELECT query_id, match_id, round(score, 6) AS score, rank FROM (SELECT a.id AS query_id, b.id AS match_id, {DOT.format(a='a.u', b='b.u')} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {DOT.format(a='a.u', b='b.u')} DESC, b.id) AS rank FROM e a JOIN e b ON a.id <> b.id AND {DOT.format(a='a.u', b='b.u')} >= 0.3) WHERE rank <= 3")
def topk_similar(spark: SparkSession, d: str) -> DataFrame:
    v = V.vectors(spark, d)
    return S.similar_topk(v, v, 0.3, 3).withColumn("score", F.round("score", 6))


@query(f"WITH e AS MATERIALIZED ({UNIT}) SELECT a.id AS query_id, round(max({DOT.format(a='a.u', b='b.u')}), 6) AS max_similarity FROM e a JOIN e b ON a.id <> b.id AND {DOT.format(a='a.u', b='b.u')} >= 0.2 GROUP BY 1")
def max_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = V.vectors(spark, d)
    return S.max_similarity(v, v, 0.2).withColumn("max_similarity", F.round("max_similarity", 6))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS rn, * FROM ({UNIT})),
 hits AS MATERIALIZED (SELECT b.rn AS y, list(a.rn) AS xs FROM e a JOIN e b ON a.rn < b.rn AND {DOT.format(a='a.u', b='b.u')} >= 0.3 GROUP BY 1),
 step(k, kept) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL
 SELECT s.k + 1, CASE WHEN h.y IS NULL OR NOT list_has_any(h.xs, s.kept) THEN list_append(s.kept, s.k + 1) ELSE s.kept END
 FROM step s LEFT JOIN hits h ON h.y = s.k + 1 WHERE s.k < (SELECT count(*) FROM e))
 SELECT id FROM e WHERE rn IN (SELECT unnest(kept) FROM step WHERE k = (SELECT count(*) FROM e))""")
def semantic_keep_first(spark: SparkSession, d: str) -> DataFrame:
    v = V.vectors(spark, d)
    return D.dedup_semantic(v.select("id"), v, 0.3, order=(), id_col="id").select("id")


# --- events -------------------------------------------------------------------------------------
CLUSTER_EDGES = f"""t AS MATERIALIZED (SELECT news_id, captured_at, source, title, {tokens_sql('title')} AS w FROM v_news),
 edges AS MATERIALIZED (SELECT a.news_id AS x, b.news_id AS y FROM t a JOIN t b ON a.news_id <> b.news_id AND len(a.w) > 0 AND len(b.w) > 0
 AND abs(epoch(a.captured_at) - epoch(b.captured_at)) <= 604800 AND {jac('a.w', 'b.w')} >= 0.45)"""
REACH = "reach(n, r) AS (SELECT DISTINCT x, x FROM edges UNION SELECT reach.n, edges.y FROM reach JOIN edges ON edges.x = reach.r)"


@query(sql(f"""WITH RECURSIVE {CLUSTER_EDGES}, {REACH}
 SELECT t.news_id, g.event_id FROM t LEFT JOIN (SELECT n, min(r) AS event_id FROM reach GROUP BY n) g ON g.n = t.news_id""", "v_news"))
def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_events(V.news(spark, d), 7 * 86400, 0.45)


@query(sql(f"""WITH RECURSIVE {CLUSTER_EDGES}, {REACH}, g AS (SELECT n, min(r) AS event_id FROM reach GROUP BY n)
 SELECT event_id, count(*) AS article_count, count(DISTINCT source) AS source_count, min(captured_at) AS first_seen, max(captured_at) AS last_updated
 FROM t JOIN g ON g.n = t.news_id GROUP BY event_id""", "v_news"))
def event_line_table(spark: SparkSession, d: str) -> DataFrame:
    n = V.news(spark, d)
    return C.event_lines(n, C.cluster_events(n, 7 * 86400, 0.45)).drop("title")


def _labelled_events(spark: SparkSession, d: str) -> DataFrame:
    """Articles grouped by a given key stand for clustered events."""
    return V.news(spark, d).withColumn("event_id", F.col("news_id") % 97)


@query(sql("""SELECT m.event_id, count(DISTINCT nullif(source, '')) AS source_count, coalesce(max(p.peak), 0) AS peak_impact, max(p.category) AS category, max(p.sentiment) AS sentiment FROM
 (SELECT *, news_id % 97 AS event_id FROM v_news) m LEFT JOIN (SELECT event_id, impact_score AS peak, category, sentiment FROM (
 SELECT n.news_id % 97 AS event_id, a.*, row_number() OVER (PARTITION BY n.news_id % 97 ORDER BY impact_score DESC, id) AS rn
 FROM v_news n JOIN v_assess a ON a.news_id = n.news_id) WHERE rn = 1) p ON p.event_id = m.event_id GROUP BY m.event_id""", "v_news", "v_assess"))
def event_momentum(spark: SparkSession, d: str) -> DataFrame:
    return C.event_momentum(_labelled_events(spark, d), V.assessments(spark, d))


@query(sql("""SELECT n.event_id, n.news_id, n.title FROM (SELECT *, news_id % 97 AS event_id FROM v_news) n""", "v_news"))
def event_member_rows(spark: SparkSession, d: str) -> DataFrame:
    # collect_list only prepares the stored shape of the members column
    n = _labelled_events(spark, d)
    events = n.groupBy("event_id").agg(F.collect_list("news_id").alias("member_ids"))
    return C.event_members(events, n.drop("event_id")).select("event_id", "news_id", "title")


@query(sql(f"""WITH e AS (SELECT news_id % 97 AS event_id, count(DISTINCT source) AS source_count, min(captured_at) AS first_seen, (news_id % 97) % 2 = 0 AS is_active FROM v_news GROUP BY 1)
 SELECT n.news_id, coalesce(e.source_count, 0) AS source_count, CASE WHEN e.first_seen IS NOT NULL THEN round(greatest(date_diff('second', e.first_seen, {AS_OF}) / 60.0, 0), 4) END AS age_minutes
 FROM v_news n LEFT JOIN e ON e.event_id = n.news_id % 97 AND e.is_active""", "v_news"))
def news_event_age(spark: SparkSession, d: str) -> DataFrame:
    n = _labelled_events(spark, d)
    e = n.groupBy("event_id").agg(F.count_distinct("source").alias("source_count"), F.min("captured_at").alias("first_seen"),
                                  (F.first("event_id") % 2 == 0).alias("is_active"))
    return C.news_event_age(n, e, V.ts(V.AS_OF)).withColumn("age_minutes", F.round("age_minutes", 4))


RES = "list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> ''))"


@query(sql(f"""WITH t AS MATERIALIZED (SELECT news_id, captured_at, {RES.format(c='snippet')} AS w, {RES.format(c='title')} AS tw FROM v_news)
 SELECT a.news_id, count(b.news_id) AS similar_count FROM t a LEFT JOIN t b ON b.news_id <> a.news_id AND b.captured_at <= a.captured_at
 AND epoch(b.captured_at) >= epoch(a.captured_at) - 3600 AND len(list_intersect(a.w, b.tw)) > len(a.w) * 0.1 GROUP BY a.news_id""", "v_news"))
def resonance(spark: SparkSession, d: str) -> DataFrame:
    return G.resonance(V.news(spark, d), 60, 0.1, text="snippet")


@query(sql("""WITH n AS MATERIALIZED (SELECT news_id, lower(snippet) AS low, list_distinct(list_filter(string_split_regex(lower(snippet), '\\s+'), lambda x: x <> '')) AS w,
 (['monetary', 'corporate', ''])[news_id % 3 + 1] AS category FROM v_news WHERE length(trim(lower(snippet))) >= 10),
 h AS MATERIALIZED (SELECT item_id AS event_no, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w,
 list_distinct([lower(split_part(text, ' ', 1)), lower(split_part(text, ' ', 2))]) AS tags, (['monetary', 'corporate', 'regulatory'])[item_id % 3 + 1] AS category,
 (['CRITICAL', 'HIGH'])[item_id % 2 + 1] AS level FROM benchmark),
 s AS (SELECT news_id, event_no, CASE WHEN n.category <> '' AND n.category = h.category THEN 30 ELSE 0 END
 + 8 * len(list_filter(h.tags, lambda t: contains(n.low, t))) + 0.5 * len(list_intersect(n.w, h.w)) + CASE WHEN level = 'CRITICAL' THEN 5 ELSE 0 END AS score FROM n CROSS JOIN h)
 SELECT news_id, event_no, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY score DESC, event_no) AS rank FROM s WHERE score >= 10) WHERE rank <= 3""", "v_news"))
def history_match(spark: SparkSession, d: str) -> DataFrame:
    b = V.read(spark, d, "benchmark")
    word = lambda i: F.lower(F.split_part("text", F.lit(" "), F.lit(i)))
    history = b.select(F.col("item_id").alias("event_no"), "text", F.array(word(1), word(2)).alias("tags"),
                       F.element_at(F.array(F.lit("monetary"), F.lit("corporate"), F.lit("regulatory")), (F.col("item_id") % 3 + 1).cast("int")).alias("category"),
                       F.element_at(F.array(F.lit("CRITICAL"), F.lit("HIGH")), (F.col("item_id") % 2 + 1).cast("int")).alias("level"))
    n = V.news(spark, d).withColumn("category", F.element_at(F.array(F.lit("monetary"), F.lit("corporate"), F.lit("")), (F.col("news_id") % 3 + 1).cast("int")))
    return G.match_history(n, history, 3, text="snippet").withColumn("score", F.col("score").cast("double"))


# --- digests and selections -----------------------------------------------------------------------
@query(sql("SELECT news_id, priority_score::DOUBLE AS priority_score, source FROM v_news WHERE priority_score > 0 ORDER BY priority_score DESC, news_id LIMIT 5", "v_news"))
def top_stories(spark: SparkSession, d: str) -> DataFrame:
    return R.top_stories(V.news(spark, d), 5).select("news_id", "priority_score", "source")


@query(sql(f"""WITH e AS (SELECT news_id % 97 AS event_id, count(DISTINCT source) AS source_count, max(captured_at) AS last_updated FROM v_news GROUP BY 1)
 SELECT (SELECT count(*) FROM v_news WHERE captured_at > {AS_OF} - INTERVAL 24 HOUR) AS articles,
 (SELECT count(*) FROM v_news WHERE captured_at > {AS_OF} - INTERVAL 24 HOUR AND status = 'fast_pushed') AS fast,
 (SELECT count(*) FROM v_news WHERE captured_at > {AS_OF} - INTERVAL 24 HOUR AND status = 'deep_pushed') AS deep,
 (SELECT count(*) FROM v_news WHERE captured_at > {AS_OF} - INTERVAL 24 HOUR AND priority_score >= 0.7) AS urgent,
 (SELECT count(*) FROM e WHERE source_count >= 2 AND last_updated > {AS_OF} - INTERVAL 24 HOUR) AS events""", "v_news"))
def digest(spark: SparkSession, d: str) -> DataFrame:
    n = _labelled_events(spark, d)
    e = n.groupBy("event_id").agg(F.count_distinct("source").alias("source_count"), F.max("captured_at").alias("last_updated"), F.lit(True).alias("is_active"))
    return A.digest_summary(n, e, V.ts(V.AS_OF))


@query(sql("""SELECT event_id, source_count FROM (SELECT news_id % 97 AS event_id, count(DISTINCT source) AS source_count FROM v_news GROUP BY 1)
 WHERE source_count >= 2 ORDER BY source_count DESC, event_id LIMIT 5""", "v_news"))
def active_events(spark: SparkSession, d: str) -> DataFrame:
    e = _labelled_events(spark, d).groupBy("event_id").agg(F.count_distinct("source").alias("source_count"), F.lit(True).alias("is_active"))
    return R.active_events(e).select("event_id", "source_count")


@query(sql("""SELECT news_id, level FROM (SELECT *, CASE WHEN priority_score >= 0.9 THEN 'critical' WHEN priority_score >= 0.7 THEN 'important' ELSE 'normal' END AS level FROM (
 (SELECT * FROM v_news WHERE status = 'fast_pushed' ORDER BY captured_at DESC, news_id DESC LIMIT 25) UNION ALL
 (SELECT * FROM v_news WHERE status = 'deep_pushed' ORDER BY captured_at DESC, news_id DESC LIMIT 25)))""", "v_news"))
def alert_history(spark: SparkSession, d: str) -> DataFrame:
    return R.alert_history(V.news(spark, d), 50).select("news_id", "level")


@query(sql("SELECT news_id, captured_at FROM v_news WHERE status = 'fast_pushed' ORDER BY captured_at DESC, news_id DESC LIMIT 50", "v_news"))
def by_status(spark: SparkSession, d: str) -> DataFrame:
    return R.by_status(V.news(spark, d), "fast_pushed").select("news_id", "captured_at")


@query(sql(f"SELECT news_id, title FROM v_news WHERE captured_at > {AS_OF} - INTERVAL 72 HOUR", "v_news"))
def recent_news(spark: SparkSession, d: str) -> DataFrame:
    return R.recent(V.news(spark, d), "captured_at", 72, V.ts(V.AS_OF)).select("news_id", "title")


@query(sql("""SELECT news_id, batch FROM (SELECT news_id, source AS batch, row_number() OVER (PARTITION BY source ORDER BY captured_at, news_id) AS rn FROM v_news) WHERE rn <= 4""", "v_news"))
def cap_per_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_per_batch(V.news(spark, d).withColumn("batch", F.col("source")), order=["captured_at", "news_id"]).select("news_id", "batch")


@query(sql("""SELECT ticker, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(title, '\\b[A-Z]{3,5}\\b')) AS ticker FROM v_headlines) GROUP BY ticker ORDER BY mentions DESC, ticker LIMIT 5""", "v_headlines"))
def ticker_mentions(spark: SparkSession, d: str) -> DataFrame:
    h = V.headlines(spark, d).withColumn("tickers", F.regexp_extract_all("title", F.lit(r"(\b[A-Z]{3,5}\b)"), F.lit(1)))
    return A.ticker_mentions(h, 5)


@query(sql("""SELECT 'documents' AS "table", count(*) AS rows FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events
 UNION ALL SELECT 'lineitem', count(*) FROM lineitem"""))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.table_counts({t: V.read(spark, d, t) for t in ("documents", "orders", "events", "lineitem")})


@query(sql("""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC, md5(text)) AS rn, role, text AS b FROM conversations),
 k AS (SELECT *, coalesce(sum(length(b)) OVER (PARTITION BY role ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE rn <= 20 AND b <> '')
 SELECT role, count(*) AS docs, string_agg('- [note] ' || b, chr(10) ORDER BY rn) AS context FROM k WHERE before < 3000 GROUP BY role"""))
def budgeted_context(spark: SparkSession, d: str) -> DataFrame:
    c = V.read(spark, d, "conversations").select("role", "conv_id", "turn", F.col("text").alias("content"), F.lit("").alias("summary"), F.lit("note").alias("type"))
    return A.budgeted_concat(c, "role", [F.desc("conv_id"), F.desc("turn"), F.md5("content")])


@query(sql("""SELECT news_id, CASE WHEN length(trim(title)) < 5 THEN 'title_too_short' WHEN greatest(length(snippet), length(title)) < 50 THEN 'content_too_short' ELSE 'ok' END AS reason FROM v_news""", "v_news"))
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    good, bad = R.quality_gate(V.news(spark, d))
    return good.select("news_id", F.lit("ok").alias("reason")).unionByName(bad.select("news_id", "reason"))


@query(sql(f"SELECT news_id, source, captured_at FROM v_news WHERE captured_at >= {AS_OF} - INTERVAL 10 DAY", "v_news"))
def retained_news(spark: SparkSession, d: str) -> DataFrame:
    return K.retain(V.news(spark, d), 10, V.ts(V.AS_OF)).select("news_id", "source", "captured_at")


@query(sql(f"SELECT f.news_id, f.reaction, f.ts FROM v_feedback f WHERE f.news_id IN (SELECT news_id FROM v_news WHERE captured_at >= {AS_OF} - INTERVAL 10 DAY)", "v_feedback", "v_news"))
def orphan_free_feedback(spark: SparkSession, d: str) -> DataFrame:
    return K.drop_orphans(V.feedback(spark, d), K.retain(V.news(spark, d), 10, V.ts(V.AS_OF)))


@query(sql("""SELECT n.news_id, coalesce(p.status, n.status) AS status, n.source FROM v_news n LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS status FROM labels) p ON p.doc_id = n.news_id""", "v_news"))
def patched_news(spark: SparkSession, d: str) -> DataFrame:
    patch = V.read(spark, d, "labels").select(F.col("doc_id").alias("news_id"), F.when(F.col("quality") == 1, "good").alias("status"))
    return K.update_fields(V.news(spark, d).select("news_id", "status", "source"), patch, "news_id")


@query(sql("""SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, ts DESC) AS rn FROM (
 SELECT user_id, value, ts, 0 AS v FROM events WHERE event_type <> 'click' UNION ALL SELECT user_id, value, ts, 1 FROM events WHERE event_type = 'click')) WHERE rn = 1"""))
def latest_preferences(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events").select("user_id", "value", "ts", "event_type")
    merged = K.latest_rows(e.filter("event_type <> 'click'"), e.filter("event_type = 'click'"), ["user_id"], "ts")
    return merged.select("user_id", "value")


@query(sql("""SELECT news_id, channel, silent FROM (SELECT news_id, (['normal', 'notable', 'important', 'critical'])[news_id % 4 + 1] AS lvl FROM v_news) n
 JOIN (VALUES ('telegram', 'critical', false), ('telegram', 'important', false), ('telegram', 'notable', true), ('pushover', 'critical', false), ('pushover', 'important', false)) c(channel, level, silent) ON c.level = n.lvl""", "v_news"))
def alert_channel_rows(spark: SparkSession, d: str) -> DataFrame:
    lvl = F.element_at(F.array(*[F.lit(x) for x in ("normal", "notable", "important", "critical")]), (F.col("news_id") % 4 + 1).cast("int"))
    return K.alert_rows(V.news(spark, d).withColumn("alert_level", lvl)).select("news_id", "channel", "silent")


@query(sql("""WITH r AS (SELECT news_id, captured_at, lower(text) AS low, text AS p, lang = 'es' AS brk FROM v_news),
 s AS (SELECT *, CASE WHEN brk THEN 1.0 WHEN contains(low, 'zation')::INT + contains(low, 'hereon')::INT >= 2 THEN 1.0
 WHEN contains(low, 'zation')::INT + contains(low, 'hereon')::INT = 1 THEN 0.9 WHEN contains(low, 'thth')::INT + contains(low, 'eswh')::INT >= 2 THEN 0.85 END AS rule FROM r),
 f AS (SELECT news_id, row_number() OVER (PARTITION BY p ORDER BY captured_at, news_id) AS rn FROM s WHERE rule IS NULL)
 SELECT s.news_id, coalesce(s.rule, CASE WHEN f.rn = 1 THEN 0.85 ELSE 0.1 END)::DOUBLE AS novelty FROM s LEFT JOIN f ON f.news_id = s.news_id""", "v_news"))
def novelty_factor(spark: SparkSession, d: str) -> DataFrame:
    n = V.news(spark, d).withColumn("is_breaking", F.col("lang") == "es")
    return W.novelty(n, shock=["zation", "hereon"], fresh=["thth", "eswh"]).select("news_id", "novelty")


@query(sql(f"SELECT coalesce(round(date_diff('second', max(captured_at), {AS_OF}) / 3600.0, 1), 999.0)::DOUBLE AS hours_since_push FROM v_news WHERE status LIKE '%pushed%' AND captured_at > {AS_OF} - INTERVAL 72 HOUR", "v_news"))
def hours_since_last_push(spark: SparkSession, d: str) -> DataFrame:
    return W.hours_since_last_push(V.news(spark, d), V.ts(V.AS_OF))


# --- tables that are written -----------------------------------------------------------------------
def _fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(sql("""WITH a AS (SELECT news_id, CASE WHEN news_id % 11 <> 0 THEN url END AS url, news_id % 2 AS part FROM v_news),
 f AS (SELECT *, row_number() OVER (PARTITION BY part, url ORDER BY news_id) AS k FROM a)
 SELECT news_id, url FROM f WHERE url IS NULL OR (k = 1 AND (part = 0 OR url NOT IN (SELECT url FROM a WHERE part = 0 AND url IS NOT NULL)))""", "v_news"))
def append_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Even articles, then odd ones: an odd one is inserted only if its URL is new; those without a URL always are."""
    n = V.news(spark, d).select("news_id", F.when(F.col("news_id") % 11 != 0, F.col("url")).alias("url"))
    path = _fresh_path(spark, "append-new")
    for part in (0, 1):
        K.append_new(n.filter(F.col("news_id") % 2 == part), path, "url", ["news_id"])
    return K.read_table(spark, path).select("news_id", "url")


@query(sql("""SELECT ticker, date, CASE WHEN CAST(ticker AS INT) % 3 = 0 THEN main_net * 2 ELSE main_net END AS main_net FROM v_flow""", "v_flow"))
def upserted_flow(spark: SparkSession, d: str) -> DataFrame:
    """All flows, then those of every third ticker again with doubled amounts; the later rows win."""
    flow = V.fund_flow(spark, d).select("ticker", "date", "main_net")
    path = _fresh_path(spark, "upsert")
    K.upsert_latest(flow, path, ["ticker", "date"])
    K.upsert_latest(flow.filter(F.col("ticker").cast("int") % 3 == 0).withColumn("main_net", F.col("main_net") * 2), path, ["ticker", "date"])
    return K.read_table(spark, path)


@query(sql("SELECT source, count(*) * 2 AS rows FROM v_news GROUP BY source", "v_news"))
def append_log_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same rows appended twice to a log by source."""
    n = V.news(spark, d).select("news_id", "source", "captured_at")
    path = _fresh_path(spark, "log")
    for _ in range(2):
        K.append_log(n, path, ["source"])
    return K.read_table(spark, path).groupBy("source").agg(F.count("*").alias("rows"))


@query()
def event_clusters_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Events by the live rule over all articles; the brute-force form is in the tests."""
    return C.cluster_events_greedy(V.news(spark, d), 7 * 86400, 0.45)
