"""Landed feed files to the ``news`` shape (title, url, source, snippet, published_at, ...).

Each reader maps one foreign shape with an explicit schema and returns all items with whole texts.
``limit`` (items per landed document or source) and the ``*_chars`` arguments shorten on request; the
described system uses 20 items (5 for company and sentiment feeds, 30 for filings and headlines) and
500 characters (800 for company news, 80 for titles taken from a text, 200 for headlines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import entities as E
from ..functions.predicates import is_noise_title
from ..functions.text import clean_html, strip
from ..operators.tagging import contains_join, mentioned_tickers
from ..operators.windows import first_per_key, top_per_key

def first_items(items: Column, limit: int | None) -> Column:
    return F.slice(items, 1, limit) if limit else items


def shorten(c: Column, chars: int | None) -> Column:
    return F.substring(c, 1, chars) if chars else c


# Zone names of RFC 822 and their offsets.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
         "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_time(c: Column) -> Column:
    """RFC 822 (numeric offset, zone name, or none: UTC) or ISO text to a UTC timestamp; null when neither fits."""
    parts = r"^\s*(?:\w{3},\s*)?(\d{1,2} \w{3} \d{4} \d{2}:\d{2})(:\d{2})?\s*([+-]\d{4}|[A-Za-z]{1,4})?\s*$"
    part = lambda i: F.regexp_extract(c, parts, i)
    zone = F.upper(part(3))
    known = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    offset = F.when(zone == "", "+0000").when(zone.rlike(r"^[+-]"), zone).otherwise(F.try_element_at(known, zone))
    seconds = F.when(part(2) == "", ":00").otherwise(part(2))
    rfc = F.try_to_timestamp(F.when(part(1) != "", F.concat(part(1), seconds, F.lit(" "), offset)), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(rfc, F.try_to_timestamp(F.when(~c.rlike(r"^\s*[A-Za-z]"), c)))


def read_rss(spark: SparkSession, path: str, source: str, as_of: Column, row_tag: str = "item",
             limit: int | None = None, snippet_chars: int | None = None) -> DataFrame:
    """RSS items of landed XML files; with ``limit`` the first items of each file."""
    schema = "title string, link string, description string, summary string, pubDate string, updated string"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    df = raw.select(strip(F.col("title")).alias("title"), strip(F.col("link")).alias("url"),
                    F.lit(source).alias("source"),
                    shorten(clean_html(F.coalesce("summary", "description", F.lit(""))), snippet_chars).alias("snippet"),
                    F.coalesce(parse_time(F.col("pubDate")), parse_time(F.col("updated")), as_of).alias("published_at"),
                    F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_pos"))
    kept = top_per_key(df, ["_file"], ["_pos"], limit) if limit else df
    return kept.filter("title <> '' and url <> ''").drop("_file", "_pos")


ZHIBO_TYPE = ("struct<result: struct<data: struct<feed: struct<list: array<struct<"
              "rich_text: string, create_time: string, docurl: string>>>>>>")


def read_zhibo(pages: DataFrame, as_of: Column, body: str = "body", channel: str = "channel",
               fallback_url: str = "", limit: int | None = None, title_chars: int | None = None,
               snippet_chars: int | None = None) -> DataFrame:
    """Live-text channel: bracketed headline as title, noise titles dropped."""
    feed = F.from_json(body, ZHIBO_TYPE)["result"]["data"]["feed"]["list"]
    rows = pages.select(channel, F.explode(first_items(feed, limit)).alias("e"))
    rich = clean_html(F.coalesce("e.rich_text", F.lit("")))
    headline = F.regexp_extract("rich", r"(?s)^【([^】]+)】(.*)$", 1)
    title = F.when(headline != "", strip(headline)).otherwise(shorten(F.col("rich"), title_chars))
    out = (rows.withColumn("rich", rich).filter("rich <> ''").withColumn("title", title)
           .filter((F.col("title") != "") & ~is_noise_title(F.col("title"))))
    return out.select("title", F.coalesce(F.nullif("e.docurl", F.lit("")), F.lit(fallback_url)).alias("url"),
                      F.concat(F.lit("新浪财经·"), channel).alias("source"),
                      shorten(F.col("rich"), snippet_chars).alias("snippet"),
                      F.coalesce(F.try_to_timestamp("e.create_time", F.lit("yyyy-MM-dd HH:mm:ss")), as_of).alias("published_at"))


LIVES_TYPE = ("struct<code: int, data: struct<items: array<struct<id: bigint, title: string, "
              "content_text: string, display_time: bigint, symbols: array<string>>>>>")


def read_live_channel(pages: DataFrame, as_of: Column, body: str = "body", channel: str = "channel",
                      limit: int | None = None, snippet_chars: int | None = None, max_symbols: int | None = None) -> DataFrame:
    """Live channel envelope (code 20000); symbols may be strings or objects with ``symbol``."""
    doc = F.from_json(body, LIVES_TYPE)
    rows = (pages.select(channel, doc.alias("d")).filter("d.code = 20000")
            .select(channel, F.explode(first_items(F.col("d.data.items"), limit)).alias("e")))
    title = strip(F.col("e.title"))
    out = rows.withColumn("title", title).filter((F.col("title") != "") & ~is_noise_title(F.col("title")))
    symbol = F.transform(F.coalesce("e.symbols", F.array().cast("array<string>")), lambda s: F.when(
        s.startswith("{"), F.get_json_object(s, "$.symbol")).otherwise(s))
    clean = shorten(clean_html(F.col("e.content_text")), snippet_chars)
    return out.select(
        "title", F.concat(F.lit("https://wallstreetcn.com/live/global/"), F.col("e.id").cast("string")).alias("url"),
        F.concat(F.lit("华尔街见闻·"), channel).alias("source"),
        F.when(F.coalesce(F.col("e.content_text"), F.lit("")) == "", F.col("title")).otherwise(clean).alias("snippet"),
        F.coalesce(F.timestamp_seconds(F.nullif("e.display_time", F.lit(0))), as_of).alias("published_at"),
        first_items(F.filter(symbol, lambda s: s != ""), max_symbols).alias("tickers"))


COMPANY_TYPE = ("array<struct<id: bigint, headline: string, url: string, source: string, summary: string, "
                "datetime: bigint>>")


def read_company_news(pages: DataFrame, as_of: Column, seen_ids: DataFrame | None = None, body: str = "body",
                      ticker: str = "ticker", limit: int | None = None, snippet_chars: int | None = None) -> DataFrame:
    """Articles per ticker response; known ids and empty headlines dropped."""
    rows = (pages.select(ticker, F.explode(first_items(F.from_json(body, COMPANY_TYPE), limit)).alias("a"))
            .filter(F.coalesce(F.col("a.headline"), F.lit("")) != ""))
    if seen_ids is not None:
        rows = rows.withColumn("id", F.col("a.id")).join(seen_ids.select("id"), "id", "left_anti")
    name = F.coalesce("a.source", F.lit("unknown"))
    return rows.select(F.col("a.id").alias("article_id"), F.col("a.headline").alias("title"),
                       F.coalesce("a.url", F.lit("")).alias("url"),
                       F.concat(F.lit("Finnhub ("), name, F.lit(")")).alias("source"),
                       shorten(F.coalesce("a.summary", F.lit("")), snippet_chars).alias("snippet"),
                       F.coalesce(F.timestamp_seconds(F.nullif("a.datetime", F.lit(0))), as_of).alias("published_at"),
                       F.array(F.col(ticker)).alias("tickers"))


def read_search_news(rows: DataFrame, keyword_tickers: DataFrame) -> DataFrame:
    """Search results (title, url, source, publish_time, related array, search_kw); a result
    without securities takes the ticker its search keyword stands for (the smallest if it stands for several)."""
    one = keyword_tickers.groupBy(F.col("keyword").alias("search_kw")).agg(F.min("ticker").alias("_t"))
    j = rows.join(one,
                  "search_kw", "left")
    has = F.coalesce(F.size("related"), F.lit(0)) > 0
    none = F.array().cast("array<string>")
    return j.select("title", "url", F.concat(F.lit("富途·"), F.coalesce("source", F.lit("资讯"))).alias("source"),
                    F.col("title").alias("snippet"), parse_time(F.col("publish_time")).alias("published_at"),
                    F.when(has, F.col("related")).when(F.col("_t").isNotNull(), F.array("_t")).otherwise(none).alias("tickers"))


def read_release_calendar(releases: DataFrame, tags=E.RELEASE_TAGS) -> DataFrame:
    """High-impact economic releases (release_id, release_name, date) as news rows."""
    from ..functions.text import first_match
    tag = first_match(F.lower("release_name"), list(tags.items()))
    t = releases.withColumn("tag", tag).filter("tag is not null")
    day = F.col("date").cast("string")
    return t.select(F.concat(F.lit("["), "tag", F.lit("] "), "release_name", F.lit(" — released "), day).alias("title"),
                    F.concat(F.lit("https://fred.stlouisfed.org/releases?rid="), F.col("release_id").cast("string")).alias("url"),
                    F.lit("FRED Economic Data").alias("source"),
                    F.concat(F.lit("FRED release: "), "release_name", F.lit(" ("), day, F.lit(")")).alias("snippet"),
                    F.array("tag").alias("macro_tags"), F.lit(0.55).alias("priority_score"))


def read_filings(entries: DataFrame, watch, document: str = "document", position: str = "position",
                 limit: int | None = None) -> DataFrame:
    """8-K entries (document, position, title, link, updated) that name a watched ticker; the
    first ``limit`` entries of each landed document when it is given."""
    kept = top_per_key(entries, [document], [position], limit) if limit else entries
    t = kept.withColumn("tickers", mentioned_tickers(F.col("title"), watch)).filter(F.size("tickers") > 0)
    return t.select(F.concat(F.lit("SEC 8-K Filing: "), "title").alias("title"), F.col("link").alias("url"),
                    F.lit("SEC EDGAR").alias("source"),
                    F.concat(F.lit("8-K filing for "), F.array_join("tickers", ","), F.lit(" — "),
                             F.coalesce("updated", F.lit(""))).alias("snippet"),
                    "tickers", F.lit(0.45).alias("priority_score"))


def read_filings_xml(spark: SparkSession, path: str, watch, limit: int | None = None) -> DataFrame:
    """The same from landed Atom files."""
    raw = (spark.read.format("xml").option("rowTag", "entry")
           .schema("title string, link struct<_href: string>, updated string").load(path))
    rows = raw.select(F.input_file_name().alias("document"), F.monotonically_increasing_id().alias("position"),
                      "title", F.col("link._href").alias("link"), "updated")
    return read_filings(rows, watch, limit=limit)


SENTIMENT_TYPE = ("struct<feed: array<struct<title: string, url: string, source: string, summary: string, "
                  "overall_sentiment_label: string>>>")


def read_sentiment_feed(pages: DataFrame, body: str = "body", ticker: str = "ticker", limit: int | None = None,
                        snippet_chars: int | None = None) -> DataFrame:
    """Articles per ticker response, distinct URLs, bullish/bearish label kept."""
    feed = F.from_json(body, SENTIMENT_TYPE)["feed"]
    rows = pages.select(ticker, F.posexplode(first_items(feed, limit)).alias("pos", "a")).filter(
        F.coalesce(F.col("a.url"), F.lit("")) != "")
    label = F.lower(F.coalesce("a.overall_sentiment_label", F.lit("")))
    shaped = rows.select(
        F.coalesce("a.title", F.lit("")).alias("title"), F.col("a.url").alias("url"),
        F.concat(F.lit("Alpha Vantage — "), F.coalesce("a.source", F.lit("unknown"))).alias("source"),
        shorten(F.coalesce("a.summary", F.lit("")), snippet_chars).alias("snippet"), F.array(F.col(ticker)).alias("tickers"),
        F.when(label.isin("bullish", "bearish"), label).otherwise("").alias("sentiment"),
        F.array(F.lit("AlphaVantage")).alias("macro_tags"), F.col(ticker).alias("_t"), F.col("pos").alias("_pos"))
    return first_per_key(shaped, ["url"], ["_t", "_pos"]).drop("_t", "_pos")


def extract_headlines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                      min_chars: int = 10, href_pattern: str | None = None, limit: int | None = None,
                      title_chars: int | None = None) -> DataFrame:
    """(page_id, pos, title, href) of the anchors of each page: titles of at least ``min_chars``
    characters, first anchor per link, relative links resolved; with ``limit`` at most so many per page."""
    rx = F.lit(r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
    anchors = F.arrays_zip(F.regexp_extract_all(html, rx, F.lit(1)).alias("href"),
                           F.regexp_extract_all(html, rx, F.lit(2)).alias("inner"))
    rows = pages.select(page_id, url, F.posexplode(anchors).alias("pos", "a"))
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "/")
    href = F.col("a.href")
    resolved = (F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
                .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"^(https?:)", 1), href))
                .when(href.startswith("/"), F.concat(origin, href))
                .when(href.startswith("#"), F.concat(F.regexp_replace(url, r"#.*$", ""), href))
                .otherwise(F.concat(base, href)))
    shaped = rows.select(page_id, "pos", clean_html(F.col("a.inner")).alias("title"), resolved.alias("href"))
    good = shaped.filter(F.length("title") >= min_chars)
    if href_pattern:
        good = good.filter(F.col("href").rlike(href_pattern))
    once = first_per_key(good, [page_id, "href"], ["pos"])
    top = top_per_key(once, [page_id], ["pos"], limit) if limit else once
    return top.withColumn("title", shorten(F.col("title"), title_chars))


def read_posts(posts: DataFrame, text: str = "text", user: str = "username", url: str = "url",
               snippet_chars: int | None = None) -> DataFrame:
    """Social posts of ten characters or more; long ones get a cut title."""
    body = strip(F.col(text))
    title = F.when(F.length("_b") <= 200, F.col("_b")).otherwise(F.concat(F.substring("_b", 1, 197), F.lit("...")))
    return (posts.withColumn("_b", body).filter(F.length("_b") >= 10)
            .select(*[c for c in posts.columns if c not in (text, user, url)], title.alias("title"),
                    F.col(url).alias("url"), F.concat(F.lit("Twitter @"), user).alias("source"),
                    shorten(F.col("_b"), snippet_chars).alias("snippet")))
