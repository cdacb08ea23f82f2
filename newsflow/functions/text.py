"""Column expressions on titles, snippets, URLs, numbers and times.

All of them stay inside Catalyst; nothing here needs a Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import dictionaries as D
from . import entities as E
from . import signal_words as S
from .lexicon import Found, Lexicon, tree

CJK = "一-鿿"
CJK_WIDE = "一-鿿㐀-䶿"


# --- building blocks --------------------------------------------------------------------
def _balanced(parts: list, combine):
    """Combine expressions pairwise so that long lists give shallow trees."""
    while len(parts) > 1:
        parts = [combine(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
    return parts[0]


def any_of(conditions: list[Column]) -> Column:
    return _balanced(list(conditions), lambda a, b: a | b) if conditions else F.lit(False)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(items: list[str]) -> Column:
    """Array literal from SQL item texts; one parse instead of one call per item."""
    return F.expr("array(" + ", ".join(items) + ")") if items else F.array().cast("array<string>")


def string_array(words) -> Column:
    return literal_array([sql_text(w) for w in dict.fromkeys(words)])


def struct_array(rows: list[dict]) -> Column:
    """Array-of-struct literal from rows of strings, ints and floats."""
    def show(v) -> str:
        return sql_text(v) if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
    return literal_array(["named_struct(" + ", ".join(f"'{k}', {show(v)}" for k, v in r.items()) + ")" for r in rows])


def contains_any(c: Column, words) -> Column:
    """True where the text contains one of the words, as written; long lists are one prefix tree."""
    listed = list(dict.fromkeys(words))
    if len(listed) <= 4:
        return any_of([c.contains(w) for w in listed])
    return c.rlike("(?s)" + tree(listed))


def matches_any(c: Column, patterns, flags: str = "(?i)") -> Column:
    return c.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def matches_word(low: Column, patterns) -> Column:
    """True where a whole-word pattern occurs in lower-case text.

    The common word boundaries are factored out, so alternatives are tried at word starts only.
    """
    groups: dict[str, list[str]] = {}
    for body in (re.sub(r"^\\b|\\b$", "", p).lower() for p in patterns):
        plain = re.match(r"[a-z](?![?*+{])", body)
        groups.setdefault(body[0] if plain else "", []).append(body[1:] if plain else body)
    parts = [f"{head}(?:{'|'.join(tails)})" for head, tails in groups.items()]
    return low.rlike(r"(?U)\b(?:" + "|".join(parts) + r")\b")


def max_weight(c: Column, weights: dict[str, float]) -> Column:
    """Highest weight among contained keywords, 0 when there is none."""
    return Lexicon({"words": weights}).found(c).max_weight("words", list(weights.values()))


def first_match(c: Column, ordered: list[tuple[str, str]]) -> Column:
    """Value of the first (keyword, value) pair whose keyword is contained; else null."""
    return Lexicon({"words": [w for w, _ in ordered]}).found(c).first("words", [v for _, v in ordered])


def count_found(c: Column, words) -> Column:
    """How many of the words are contained."""
    return Lexicon({"words": words}).found(c).count("words")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def empty(c: Column) -> Column:
    return c.isNull() | (c == "")


# --- URLs, titles, fingerprints ----------------------------------------------------------
def normalize_url(c: Column) -> Column:
    no_fragment = F.substring_index(c, "#", 1)
    no_tracking = F.regexp_replace(
        no_fragment, r"[?&](utm_\w+|ref|source|fbclid|gclid)=[^&]*", "")
    return F.regexp_replace(no_tracking, r"[?&]$", "")


def _prefix_pattern() -> str:
    heads = [re.escape(p) for p in D.URGENCY_PREFIXES]
    return "^(?:" + "|".join(heads) + ")"


def strip_prefix(c: Column) -> Column:
    """Drop one leading urgency marker and the blanks around the rest."""
    pattern = _prefix_pattern()
    return F.when(c.rlike(pattern), strip(F.regexp_replace(c, pattern, ""))).otherwise(c)


def content_fingerprint(title: Column, snippet: Column, head_chars: int | None = None) -> Column:
    """Digest of title and snippet; with ``head_chars`` (300 in the described system) of the snippet's head only."""
    head = strip_prefix(F.coalesce(title, F.lit("")))
    body = F.coalesce(snippet, F.lit(""))
    body = F.substring(body, 1, head_chars) if head_chars else body
    return F.sha2(F.concat(head, F.lit("|"), body), 256)


def event_title(c: Column) -> Column:
    markers = "|".join(D.EVENT_TITLE_MARKERS)
    return strip(F.regexp_replace(c, rf"(?i)^({markers})\s*[:-]?\s*", ""))


def title_tokens(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s]", "")
    return F.array_remove(F.array_distinct(F.split(kept, r"(?U)\s+")), "")


def mixed_tokens(c: Column) -> Column:
    """CJK characters one by one, other alphanumeric runs whole."""
    pattern = rf"([{CJK_WIDE}]|[\p{{L}}\p{{N}}&&[^{CJK_WIDE}]]+)"
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1)))


def word_set(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(c), r"(?U)\s+")), "")


def jaccard(a: Column, b: Column) -> Column:
    overlap = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - overlap
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(overlap / union)


def clean_html(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"<[^>]+>", ""))


def cjk_ratio(c: Column) -> Column:
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    letters = F.length(F.regexp_replace(c, rf"[^\p{{L}}{CJK}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(cjk / letters)


def is_chinese_dominant(c: Column) -> Column:
    return cjk_ratio(c) > 0.25


# --- numbers ------------------------------------------------------------------------------
def parse_number(c: Column) -> Column:
    """'1,234K' -> 1234000; a trailing % is ignored; null when not a number."""
    s = F.regexp_replace(F.regexp_replace(strip(c), "[,+]", ""), "−", "-")
    unit = F.upper(F.substring(s, -1, 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    digits = F.regexp_replace(F.regexp_replace(s, "[KMBkmb]$", ""), "%$", "")
    number = F.when(digits.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))
    return number * factor


def _deviation_band(actual: Column, expected: Column) -> Column:
    off = F.try_divide(F.abs(actual - expected), F.abs(expected))
    chain = F.when(off.isNull(), F.lit(0.0))
    for bound, score in D.DEVIATION_BANDS:
        chain = chain.when(off >= bound, F.lit(score))
    return chain.otherwise(F.lit(D.DEVIATION_SMALLEST))


def deviation_max(c: Column) -> Column:
    """Strongest 'actual vs expected' deviation in the text, 0..1."""
    scores = []
    none = F.lit(0.0)
    for pattern, actual_group, expected_group in D.DEVIATION_NUMBERS:
        text = "(?iU)" + pattern
        rx = F.lit(text)
        pairs = F.arrays_zip(
            F.regexp_extract_all(c, rx, F.lit(actual_group)).alias("a"),
            F.regexp_extract_all(c, rx, F.lit(expected_group)).alias("e"))
        scores.append(F.when(c.rlike(text), F.array_max(F.transform(
            pairs, lambda p: _deviation_band(parse_number(p["a"]), parse_number(p["e"]))))))
    said = F.regexp_extract_all(c, F.lit("(?i)" + D.DEVIATION_DIRECTION), F.lit(1))
    worded = F.coalesce(F.array_max(F.transform(said, lambda w: F.when(
        w.isin(D.BEAT_WORDS), F.lit(D.DEVIATION_BEAT)).when(
        w.isin(D.MISS_WORDS), F.lit(D.DEVIATION_MISS)).otherwise(none))), none)
    # numbers and a word of comparison are needed for a number pattern
    counted = F.when(c.rlike(r"(?U)\d") & c.rlike(r"(?iU)vs|versus|expected|forecast|est|预期|预估|预测|估计"),
                     F.greatest(*[F.coalesce(s, none) for s in scores])).otherwise(none)
    return F.coalesce(F.greatest(counted, worded), none)


def deviation_score(c: Column, weight: float = D.PRIORITY_WEIGHTS["deviation"]) -> Column:
    # the digit/keyword guard keeps the eight pattern scans off titles that cannot match
    may_match = c.rlike(r"(?iU)vs|versus|expected|forecast|est|expectations|consensus|预期|预估|预测|估计")
    return F.round(F.when(may_match, deviation_max(c)).otherwise(F.lit(0.0)) * weight, 4)


# --- keyword intensity ---------------------------------------------------------------------
# ``found`` answers from one scan of the lower-case text (vocabulary.py) instead of a scan per list
def surprise_score(c: Column, weights: dict[str, float] = D.SURPRISE_WEIGHTS,
                   weight: float = D.PRIORITY_WEIGHTS["surprise"], found: Found | None = None) -> Column:
    top = found.max_weight("surprise", list(weights.values())) if found else max_weight(F.lower(c), weights)
    return F.round(top * weight, 4)


def business_intensity(c: Column, weights: dict[str, float] = D.BUSINESS_IMPACT_WEIGHTS, found: Found | None = None) -> Column:
    low = F.lower(c)
    raised = F.when(low.rlike("(?U)" + D.PRICE_RAISE), D.PRICE_RAISE_WEIGHT).otherwise(F.lit(0.0))
    return F.greatest(found.max_weight("business", list(weights.values())) if found else max_weight(low, weights), raised)


def business_impact_score(c: Column, weights: dict[str, float] = D.BUSINESS_IMPACT_WEIGHTS,
                          weight: float = D.PRIORITY_WEIGHTS["business_impact"], found: Found | None = None) -> Column:
    return F.round(business_intensity(c, weights, found) * weight, 4)


def asset_class_count(c: Column, classes: dict[str, list[str]] = D.ASSET_CLASSES, found: Found | None = None) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [(found.any(f"asset:{name}") if found else contains_any(low, words)).cast("int")
                                       for name, words in classes.items()])


def asset_linkage_score(c: Column, classes: dict[str, list[str]] = D.ASSET_CLASSES,
                        weight: float = D.PRIORITY_WEIGHTS["asset_linkage"], found: Found | None = None) -> Column:
    hits = asset_class_count(c, classes, found)
    factor = F.lit(D.ASSET_CLASS_FACTORS[4])
    chain = F.when(hits == 0, D.ASSET_CLASS_FACTORS[0])
    for n in (1, 2, 3):
        chain = chain.when(hits == n, D.ASSET_CLASS_FACTORS[n])
    return F.round(chain.otherwise(factor) * weight, 4)


def is_breaking(c: Column, markers=D.BREAKING_MARKERS) -> Column:
    return c.rlike("(?iu)" + "|".join(re.escape(m) for m in markers))


# --- report sections ------------------------------------------------------------------------
def extract_section(c: Column, name: str, longest: int | None = None, line_chars: int | None = None, text_chars: int | None = None) -> Column:
    """Struct(text, found): a named report section, or the first long line or else the text as a guess.

    Sections of more than ``longest`` characters are not matched, and guesses are cut to ``line_chars`` and
    ``text_chars``; None is no bound. The reference has 800, 500 and 300.
    """
    section = re.escape(name)
    stop = r"(?=\n\n|\n#|\n\d+\."
    size = f"{{10,{'' if longest is None else longest}}}"
    tries = [
        rf"(?s)#+\s*{section}\s*\n+(.{size}?){stop}|\z)",
        rf"(?s){section}[：:]\s*\n?(.{size}?){stop}|\n📌|\n🎯|\z)",
        rf"(?s)\d+\.\s*{section}\s*\n+(.{size}?){stop}|\z)",
    ]
    hit = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in tries])
    lines = F.filter(F.transform(F.split(c, "\n"), strip),
                     lambda s: (F.length(s) > 30) & ~s.startswith("#") & ~s.startswith("-"))
    cut = lambda x, n: x if n is None else F.substring(x, 1, n)
    guess = F.coalesce(cut(F.get(lines, F.lit(0)), line_chars), cut(c, text_chars))
    return F.struct(F.coalesce(strip(hit), guess).alias("text"), hit.isNotNull().alias("found"))


# --- tickers and markets --------------------------------------------------------------------
def market_of(ticker: Column) -> Column:
    return F.when(ticker.rlike(r"^\d{5}$"), "HK").otherwise("US")


def symbol_code(ticker: Column) -> Column:
    return F.concat(market_of(ticker), F.lit("."), ticker)


def security_id(ticker: Column, known: dict[str, int] = E.KNOWN_MARKETS) -> Column:
    """'<market number>.<code>': known listings first, digits are Hong Kong, else NASDAQ."""
    up = F.upper(ticker)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    market = F.try_element_at(table, up)
    return (F.when(market.isNotNull(), F.concat(market.cast("string"), F.lit("."), up))
            .when(ticker.rlike(r"^\d+$"), F.concat(F.lit("116."), F.when(
                F.length(ticker) < 5, F.lpad(ticker, 5, "0")).otherwise(ticker)))
            .otherwise(F.concat(F.lit("105."), up)))


def market_name(number: Column) -> Column:
    chain = None
    for value, label in E.MARKET_NUMBERS.items():
        chain = F.when(number == value, label) if chain is None else chain.when(number == value, label)
    return chain.otherwise(F.concat(F.lit("MKT"), number.cast("string")))


# --- small classifications --------------------------------------------------------------------
def sentiment_class(x: Column, compat: bool = False) -> Column:
    """Five classes; ``compat`` keeps the order in which cautiously_bearish cannot occur."""
    top = F.when(x >= 0.15, "bullish").when(x >= 0.05, "cautiously_bullish")
    if compat:
        return (top.when(x > -0.15, "neutral").when(x >= -0.05, "cautiously_bearish")
                .otherwise("bearish"))
    return (top.when(x > -0.05, "neutral").when(x > -0.15, "cautiously_bearish")
            .otherwise("bearish"))


def market_impact_class(priority: Column, tickers: Column) -> Column:
    return (F.when((priority >= 0.7) | (tickers >= 3), "high")
            .when((priority >= 0.4) | (tickers >= 1), "medium").otherwise("low"))


# --- trading time ------------------------------------------------------------------------------
def to_eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "America/New_York")


def is_trading_day(day: Column, holidays=E.HOLIDAYS) -> Column:
    closed = day.isin([F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    return ~F.dayofweek(day).isin(1, 7) & ~closed


def next_trading_day(day: Column, holidays=E.HOLIDAYS, horizon: int = 30) -> Column:
    """First trading day after ``day``; ``horizon`` must exceed the longest closure."""
    days = F.sequence(F.date_add(day, 1), F.date_add(day, horizon))
    return F.get(F.filter(days, lambda d: is_trading_day(d, holidays)), F.lit(0))


def market_session(ts_utc: Column, holidays=E.HOLIDAYS) -> Column:
    et = to_eastern(ts_utc)
    minute = F.hour(et) * 60 + F.minute(et)
    return (F.when(~is_trading_day(et.cast("date"), holidays), "weekend")
            .when(minute >= 20 * 60, "overnight").when(minute >= 16 * 60, "after-hours")
            .when(minute >= 9 * 60 + 30, "regular").when(minute >= 4 * 60, "pre-market")
            .otherwise("overnight"))


# --- topics and suppression keys -----------------------------------------------------------------
def topic_tags(c: Column, topics: dict[str, list[str]] = S.TOPIC_WORDS, k: int = 5) -> Column:
    """Up to k topics by number of distinct matching keywords; ties in dictionary order."""
    low = F.lower(c)
    scored = F.array(*[
        F.struct((-count_found(low, [w.lower() for w in words])).alias("n"),
                 F.lit(i).alias("pos"), F.lit(topic).alias("topic"))
        for i, (topic, words) in enumerate(topics.items())])
    hits = F.array_sort(F.filter(scored, lambda s: s["n"] < 0))
    return F.transform(F.slice(hits, 1, k), lambda s: s["topic"])


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(c, r"(?U)\s+"), ""))


def doc_quality(text: Column, summary: Column, topics: Column) -> Column:
    n = word_count(text)
    length = (F.when(n.between(200, 2000), 2.0).when(n.between(50, 199), 1.0)
              .when(n > 2000, 1.5).otherwise(0.0))
    short = F.when((summary != "") & (F.length(summary) < F.length(text) * 0.8), 0.5).otherwise(0.0)
    score = F.lit(5.0) + length + F.least(F.size(topics) * 0.5, F.lit(2.0)) + F.coalesce(short, F.lit(0.0))
    return F.round(F.least(score, F.lit(10.0)), 1)


def macro_topic(headline: Column) -> Column:
    """Topic whose pattern matches earliest in the headline; list order breaks ties."""
    spots = []
    for i, (pattern, topic) in enumerate(S.MACRO_TOPICS):
        rx = "(?iU)" + pattern
        # an unmatched pattern gives 0, so it sorts behind every real position
        pos = F.regexp_instr(headline, F.lit(rx))
        spots.append(F.struct(F.when(pos > 0, pos).otherwise(2147483647).alias("pos"),
                              F.lit(i).alias("rank"), F.lit(topic).alias("topic")))
    best = F.least(*spots)
    return F.when(best["pos"] < 2147483647, best["topic"])


def dedup_key(tickers: Column, headline: Column, title: Column, direction: Column) -> Column:
    """Same-event key of an alert: tickers, else macro topic, else headline hash, else null."""
    way = F.coalesce(F.nullif(direction, F.lit("")), F.lit("up"))
    codes = F.array_sort(F.array_distinct(F.array_remove(F.transform(
        F.coalesce(tickers, F.array().cast("array<string>")),
        lambda t: F.upper(strip(F.coalesce(t, F.lit(""))))), "")))
    text = F.coalesce(F.nullif(headline, F.lit("")), title, F.lit(""))
    topic = macro_topic(text)
    trimmed = strip(text)
    return (F.when(F.size(codes) > 0, F.concat_ws(":", F.lit("ticker"), F.array_join(codes, ","), way))
            .when(topic.isNotNull(), F.concat_ws(":", F.lit("macro"), topic, way))
            .when(F.length(trimmed) > 10,
                  F.concat(F.lit("headline:"), F.substring(F.md5(trimmed.cast("binary")), 1, 12))))


def register_sql_functions(spark) -> None:
    """Expose the scalar helpers to SQL text as temporary SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_url(u STRING) RETURNS STRING RETURN "
              "regexp_replace(regexp_replace(substring_index(u, '#', 1), "
              "r'[?&](utm_\\w+|ref|source|fbclid|gclid)=[^&]*', ''), r'[?&]$', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) "
              "RETURNS DOUBLE RETURN CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D "
              "ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION parse_number(s STRING) RETURNS DOUBLE RETURN "
              "try_cast(regexp_replace(regexp_replace(s, '[,+%]', ''), '[KMBkmb]$', '') AS DOUBLE) * "
              "CASE upper(substr(trim(s), -1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1e0 END")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that later references do not repeat their work."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def once_per_value(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the distinct values of ``keys``, joined back to all rows that have them.

    For costly rules of texts that many rows share: a text is read once, its rows only meet the result. ``work``
    keeps the columns it is given and adds, replaces, drops or repeats row by row; it sees no other columns than
    ``keys``. A stream has no distinct values at hand, there ``work`` runs on the rows.
    """
    if df.isStreaming:
        return work(df)
    mark = {k: f"_value_{i}" for i, k in enumerate(keys)}
    parts = df.sparkSession.sparkContext.defaultParallelism * 4  # few bytes, much work: no merging of partitions
    values = df.select(*keys).distinct().repartition(parts, *keys)
    made = work(values.withColumns({m: F.col(k) for k, m in mark.items()}))
    rest = df.select(*[F.col(k).alias(f"_of{m}") for k, m in mark.items()], *[c for c in df.columns if c not in made.columns])
    on = reduce(lambda a, b: a & b, [F.col(f"_of{m}").eqNullSafe(F.col(m)) for m in mark.values()])
    return rest.join(made, on).drop(*mark.values(), *[f"_of{m}" for m in mark.values()])


def with_tokens(df: DataFrame, title: str = "title", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, title_tokens(F.coalesce(F.col(title), F.lit(""))))
