"""Golden rows of the text, filter and scoring expressions."""

import pytest
from pyspark.sql import functions as F

from newsflow.functions import predicates as P
from newsflow.functions import strategic as Z
from newsflow.functions import text as T
from newsflow.operators import scoring as C
from newsflow.operators import tagging as G


def value(spark, text, make):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(make(F.col("t")).alias("v")).first()["v"]


def test_url_and_titles(spark):
    assert value(spark, "http://a/x?utm_source=b&ref=c", T.normalize_url) == "http://a/x"
    assert value(spark, "http://a/x?ref=c&b=2#top", T.normalize_url) == "http://a/x&b=2"
    assert value(spark, "BREAKING: Iran attacks ships ", T.strip_prefix) == "Iran attacks ships"
    assert value(spark, "breaking: x", T.strip_prefix) == "breaking: x"
    assert value(spark, "突发:油价", T.strip_prefix) == "油价"
    assert value(spark, "Flash crash hits", T.event_title) == "crash hits"
    assert value(spark, "A flash crash", T.event_title) == "A flash crash"


def test_tokens_and_numbers(spark):
    assert set(value(spark, "TSMC 台积 up 3%", T.mixed_tokens)) == {"tsmc", "台", "积", "up", "3"}
    assert value(spark, "中文标题", T.title_tokens) == []
    assert value(spark, "1,234K", T.parse_number) == 1234000
    assert value(spark, "−2.5%", T.parse_number) == -2.5
    assert value(spark, "n/a", T.parse_number) is None
    assert value(spark, "CPI 2.9% vs 2.7% expected", T.deviation_score) == pytest.approx(0.175)
    assert value(spark, "raise chipmaking prices", T.business_intensity) == 0.9
    assert value(spark, "price hike price increase", T.business_impact_score) == value(spark, "price hike", T.business_impact_score)


def test_suppression_keys(spark):
    def key(tickers, headline, way="up"):
        df = spark.createDataFrame([(tickers, headline, way)], "a array<string>, h string, w string")
        return df.select(T.dedup_key(F.col("a"), F.col("h"), F.col("h"), F.col("w")).alias("k")).first()["k"]
    assert key(["MSFT", "AAPL"], "x", "down") == "ticker:AAPL,MSFT:down"
    assert key([], "US CPI hot") == "macro:inflation:up"
    assert key([], "银行财报季开启 盈利强劲") == "macro:bank_earnings:up"
    assert key([], "rate cut hopes") == "macro:fed_rate:up"
    assert key([], "short") is None


@pytest.mark.parametrize("text, geo", [
    ("Venezuela government collapses", 0.2), ("Venezuela oil supply cut", 1.0), ("Iran festival", 0.6),
    ("国务院 学习贯彻", 0.15), ("Apple earnings", 1.0)])
def test_geo(spark, text, geo):
    assert value(spark, text, P.geo_market_multiplier) == geo


def test_quality(spark):
    no = F.lit(False)
    assert value(spark, "ECB holds rates", lambda c: P.geo_tier_weight(c, no)) == 0.25
    assert value(spark, "Fed's Powell on ECB and the U.S. economy", lambda c: P.geo_tier_weight(c, no)) == 1.0
    assert value(spark, "ECB holds rates", lambda c: P.geo_tier_weight(c, F.lit(True))) == 1.0
    assert value(spark, "党委学习贯彻重要讲话", lambda c: P.content_quality_multiplier(c, no, no)) == 0.15
    assert value(spark, "605358 涨停", lambda c: P.content_quality_multiplier(c, no, no)) == 0.3
    assert value(spark, "Stock up 3% after note", lambda c: P.content_quality_multiplier(c, no, no)) == 0.3
    assert value(spark, "Company plunges 25% on fraud", lambda c: P.is_single_stock_noise(c, no)) is False
    assert value(spark, "Trump defends record", lambda c: P.content_quality_multiplier(c, no, no)) == 0.3
    assert value(spark, "New minister sworn in", lambda c: P.content_quality_multiplier(c, no, no)) == 0.2


def test_strategic(spark):
    def best(text):
        m = value(spark, text, Z.strategic_matches)
        return (m[0]["category"], m[0]["conf"]) if m else None
    assert best("CHIPS Act grant of $3 billion for fab") == ("gov_intervention", 1.0)
    assert best("Jensen Huang invests in Marvell")[0] == "nvda_investment"
    assert best("NVIDIA endorses new partner platform")[0] == "nvda_endorsement"
    assert best("Local bakery wins prize") is None
    assert best("Regulator says drug treatment delayed") is None


def test_tickers_and_people(spark):
    assert value(spark, "NVDA and $XYZ rise, 台积电 too, ABCDEFG not", G.extract_tickers) == ["NVDA", "TSM", "XYZ"]
    assert value(spark, "farm output", G.extract_tickers) == ["ARM"]
    assert value(spark, "farm output", lambda c: G.extract_tickers(c, word_boundary=True)) == []
    assert tuple(value(spark, "Donald Trump met Elon Musk", G.people_tier)) == (True, 2)
    assert tuple(value(spark, "nobody", G.people_tier)) == (False, 1)


def test_urgent_priority_class(spark):
    df = spark.createDataFrame([("BREAKING: Fed shocks markets",)], "t string")
    score = C.priority_score(F.col("t"), F.lit(True), F.lit(4), F.lit(3), F.lit("Reuters"), F.lit(True), F.lit(1), F.lit(4))
    row = df.select(score.alias("s"), C.priority_class(score).alias("c")).first()
    assert row["s"] >= 0.7 and row["c"] == "urgent"


def test_screen_respects_geography(spark):
    news = spark.createDataFrame([(1, "Venezuela election: Jensen Huang invests in local firm", "", "CNBC"),
                                  (2, "Jensen Huang invests in Marvell", "", "CNBC"),
                                  (3, "Quiet day at the office", "", "Blog")], "news_id long, title string, snippet string, source string")
    rows = {r["news_id"]: r for r in C.screen(news, keep_all=True).collect()}
    assert rows[2]["priority_score"] >= 1.0 and "STRATEGIC_NVDA_INVESTMENT" in rows[2]["macro_tags"]
    assert rows[1]["priority_score"] < 1.0
    assert rows[3]["priority_score"] < 0.3


def test_macro_detection_skips_previews(spark):
    assert value(spark, "CPI rises to 3%", lambda c: P.macro_indicator(c)["indicator"]) == "CPI"
    assert value(spark, "What to watch: CPI preview", P.macro_indicator) is None


def test_sections(spark):
    doc = "intro\n\n### 操作建议\n\n持有观望，等待财报后再做决定。\n\n### 风险\n\nabc"
    got = value(spark, doc, lambda c: T.extract_section(c, "操作建议"))
    assert got["found"] and got["text"].startswith("持有观望")
    assert value(spark, "no header here", lambda c: T.extract_section(c, "操作建议"))["found"] is False


def test_long_sections_are_whole(spark):
    body, line = "advice " * 300, "x" * 900
    doc = f"top\n\n### Advice\n\n{body}\n\n### Risk\n\nnone"
    got = value(spark, doc, lambda c: T.extract_section(c, "Advice"))
    assert got["found"] and got["text"] == body.strip()
    assert not value(spark, doc, lambda c: T.extract_section(c, "Advice", 800, 500, 300))["found"]
    assert value(spark, line, lambda c: T.extract_section(c, "Advice"))["text"] == line


def test_sentiment_reads_the_three_words_before(spark):
    from newsflow.operators.aggregates import lexicon_sentiment
    cases = {"surge": 2.5, "not surge": 2.5 * -0.74, "very surge": 2.5 + 0.293, "very big surge": 2.5 + 0.293 * 0.95, "slightly a b surge": 2.5 - 0.293 * 0.9,
             "very a b c surge": 2.5, "not very crash": (-3.0 - 0.293) * -0.74, "isn't 'crash'": -3.0 * -0.74, "not crash surge": -3.0 * -0.74 + 2.5 * -0.74, "no words": 0.0}
    df = spark.createDataFrame([(t, v) for t, v in cases.items()], "text string, v double")
    for r in lexicon_sentiment(df, id_col="text").collect():
        assert r["sentiment_score"] == round(r["v"] / (r["v"] ** 2 + 15) ** 0.5, 4), r["text"]


def test_shared_headlines_are_read_once_and_screened_as_rows(spark):
    titles = ["BREAKING: CPI rose 30% vs 20% expected", "Nvidia beats estimates, raises guidance", None, "", "Pentagon awards Intel a defense contract worth $5 billion"]
    rows = [(i, titles[i % 5], None if i % 2 else "", ("Bloomberg", "", None)[i % 3], [None, 0, 6][i % 3]) for i in range(120)]
    news = spark.createDataFrame(rows, "news_id long, title string, snippet string, source string, similar_count int")
    shown = ["news_id", "title", "source", "similar_count", "priority_score", "filter_multiplier", "macro_tags", "tickers"]
    whole = C.screen(news, keep_all=True).select(shown).collect()
    assert len(whole) == 120 and sorted(map(repr, whole)) == sorted(map(repr, C._screen(news, C.E.DEFAULT_WATCHLIST, (), 0.3, True).select(shown).collect()))
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(x):
        read.add(1)
        return None if x is None else len(x)

    got = T.once_per_value(news.select("news_id", "title"), ["title"], lambda h: T.once(h, n=length("title"))).collect()
    assert read.value == 5 and {(r["news_id"], r["title"], r["n"]) for r in got} == {(i, t, None if t is None else len(t)) for i, t, *_ in rows}
