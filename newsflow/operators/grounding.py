"""Sentence-level check of generated analyses against the quotes they had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_any

# fixed values of the check
DOWN_WORDS = ["下跌", "大跌", "暴跌", "重挫", "跳水", "下挫", "崩跌", "跌超", "跌幅", "收跌", "走低",
              "下探", "急跌", "杀跌", "低开"]
UP_WORDS = ["上涨", "大涨", "暴涨", "飙升", "拉升", "走高", "涨超", "涨幅", "收涨", "冲高", "急涨",
            "高开", "走强"]
DOWN_EN = ["fell", "fall", "drop", "plunge", "slump", "tumble", "sank", "sink"]
UP_EN = ["rose", "rise", "surge", "jump", "gain", "rally", "rallied", "soar", "climb"]
BARE_DOWN = r"跌\s*了?\s*[约近]?\s*[+-]?\d"
BARE_UP = r"涨\s*了?\s*[约近]?\s*[+-]?\d"
CONDITIONAL = r"若|如果|一旦|倘|假如|万一|假设|设想|[\d%％]\s*[时即则]"
HEDGE = r"不会|不再|不.{0,2}[涨跌]|未.{0,2}[涨跌]|无.{0,2}[涨跌]|难.{0,3}[涨跌]|没.{0,3}[涨跌]|收窄|收敛|走完|结束|企稳|见底|触底|止跌|止住|反转|扭转"
MARKET_SUBJECT = r"市场|大盘|指数|板块|标普|道指|纳指|纳斯达克|恒生|A股|美股|SPX|VIX|对手|同业|同行|竞品|友商|其他|大市|全场"
TRADE_WORDS = ["做多", "做空", "买入", "卖出", "加仓", "减仓", "抄底", "止损", "止盈", "建仓", "清仓",
               "空头", "多头", "逢高", "逢低", "short", "long", "buy", "sell"]
NUMBER = r"\d[\d,]*(?:\.\d+)?"
LIVE_PRICE = rf"(?:现价|现报|最新价)\s*[:：]?\s*[$￥]?({NUMBER})"
DOLLAR_PRICE = rf"\$\s?({NUMBER})"
YUAN_PRICE = rf"({NUMBER})\s?(?:美元|元)"
LEVEL_PRICE = rf"(?:目标价?|止损|止盈|支撑位?|阻力位?|点位|建仓|买入价|卖出价|现价|现报|最新价)\s*[:：]?\s*({NUMBER})"
PERCENT = r"[+-]?(\d+(?:\.\d+)?)\s?(?:%|％|个百分点)"


def _numbers(c: Column, pattern: str) -> Column:
    """Matched figures without separators or trailing zeros, the way quotes are shown."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(
        F.replace(x, F.lit(","), F.lit("")), r"(\.\d*?)0+$", "$1"), r"\.$", ""))



def flag_ungrounded_claims(analyses: DataFrame, quotes: DataFrame, id_col: str = "news_id",
                           text: str = "analysis", tickers: str = "tickers") -> tuple[DataFrame, DataFrame]:
    """(cleaned, flagged): analyses with ungrounded sentences removed, and those sentences.

    quotes  one row per ticker: ticker, last, change_pct, ma20, ma50
    A sentence is flagged for a live price that is not in the quotes, for the direction opposite
    to the real move, and, where an analysis has no quotes at all, for any price, percent or
    trade call.
    """
    def number(c: str) -> Column:
        shown = F.round(F.abs(c), 2).cast("decimal(18,2)").cast("string")
        return F.regexp_replace(shown, r"\.?0+$", "")
    # one quote per ticker: of several the largest in column order
    one = quotes.groupBy(F.upper("ticker").alias("_t")).agg(F.max(F.struct("last", "change_pct", "ma20", "ma50")).alias("q")).select("_t", "q.*")
    facts = one.select(
        "_t",
        F.array_compact(F.array(number("last"), number("change_pct"), number("ma20"), number("ma50"))).alias("nums"),
        F.when(F.col("change_pct") < 0, "-").otherwise("+").alias("sign"))
    named = analyses.select(id_col, F.explode(tickers).alias("_t")).withColumn("_t", F.upper(F.trim("_t"))).distinct()
    known = (named.join(facts, "_t").groupBy(id_col).agg(
        F.flatten(F.collect_list("nums")).alias("grounded"),
        F.map_from_entries(F.collect_list(F.struct("_t", "sign"))).alias("signs")))
    first = F.upper(F.trim(F.get(tickers, F.lit(0))))
    parts = F.split(F.col(text), r"(?<=[。！？!?；;\n])")
    s = F.col("sentence")
    rows = (analyses.select(id_col, first.alias("primary"), F.posexplode(parts).alias("pos", "sentence"))
            .filter(F.trim(s) != "").join(known, id_col, "left")
            .withColumn("no_data", F.col("grounded").isNull()))
    ok = F.coalesce("grounded", F.array().cast("array<string>"))
    live = F.size(F.array_except(_numbers(s, LIVE_PRICE), ok)) > 0
    low = F.lower(s)
    down = contains_any(s, DOWN_WORDS) | s.rlike(BARE_DOWN) | contains_any(low, DOWN_EN)
    up = contains_any(s, UP_WORDS) | s.rlike(BARE_UP) | contains_any(low, UP_EN)
    claimed = F.when(down & ~up, "-").when(up & ~down, "+")
    signs = F.coalesce("signs", F.create_map().cast("map<string,string>"))
    subjects = F.filter(F.map_keys(signs), lambda t: F.contains(s, t))
    sole = F.when(F.map_contains_key(signs, F.coalesce("primary", F.lit(""))), F.array("primary")).when(
        F.size(signs) == 1, F.map_keys(signs)).otherwise(F.array().cast("array<string>"))
    about = F.when(F.size(subjects) > 0, subjects).when(s.rlike(MARKET_SUBJECT), F.array().cast("array<string>")).otherwise(sole)
    contrary = (claimed.isNotNull() & ~s.rlike(CONDITIONAL) & ~s.rlike(HEDGE)
                & F.exists(about, lambda t: F.try_element_at(signs, t) != claimed))
    figures = F.concat(_numbers(s, DOLLAR_PRICE), _numbers(s, YUAN_PRICE), _numbers(s, LEVEL_PRICE), _numbers(s, PERCENT))
    invented = F.col("no_data") & (F.size(figures) > 0)
    call = F.col("no_data") & contains_any(low, TRADE_WORDS)
    why = (F.when(live, "live_price").when(~F.col("no_data") & contrary, "direction")
           .when(invented, "no_data_number").when(call, "no_data_trade_call"))
    marked = rows.withColumn("flag", why)
    flagged = marked.filter("flag is not null").select(id_col, "pos", "flag", F.trim(s).alias("sentence"))
    cleaned = (marked.filter("flag is null").groupBy(id_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), "").alias("text")))
    return (analyses.select(id_col).join(cleaned, id_col, "left")
            .select(id_col, F.coalesce("text", F.lit("")).alias("text")), flagged)
