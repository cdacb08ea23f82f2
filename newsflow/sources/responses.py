"""Stored model responses (raw text) to typed verdict columns, with rejects kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip


def unfence(c: Column) -> Column:
    """Text inside an optional Markdown code fence."""
    t = strip(c)
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(
        t, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)


def _parsed(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``_j`` (fence-free JSON) and ``_ok`` (is a JSON object)."""
    d = df.withColumn("_j", unfence(F.coalesce(F.col(raw), F.lit(""))))
    return d.withColumn("_ok", F.try_parse_json("_j").isNotNull() & F.col("_j").rlike(r"(?s)^\s*\{"))


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object("_j", f"$.{name}"), F.lit(default))


def _number(name: str, default: float) -> Column:
    return F.coalesce(F.get_json_object("_j", f"$.{name}").try_cast("double"), F.lit(float(default)))


def _strings(name: str) -> Column:
    items = F.from_json(F.get_json_object("_j", f"$.{name}"), "array<string>")
    return F.coalesce(F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s != ""),
                      F.array().cast("array<string>"))


def _ints(name: str) -> Column:
    items = F.from_json(F.get_json_object("_j", f"$.{name}"), "array<string>")
    return F.coalesce(F.filter(F.transform(items, lambda s: s.try_cast("double").cast("int")),
                               lambda v: v.isNotNull()), F.array().cast("array<int>"))


def _flag(name: str) -> Column:
    return F.coalesce(F.lower(F.get_json_object("_j", f"$.{name}")).isin("true", "1"), F.lit(False))


def parse_impact_responses(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(assessments, rejects)."""
    d = _parsed(df, raw)
    good = d.filter("_ok").select(
        *df.columns, _number("impact_score", 0).alias("impact_score"), _number("confidence", 0).alias("confidence"),
        _text("event_category").alias("event_category"), _text("surprise_level").alias("surprise_level"),
        _text("breadth").alias("breadth"), F.upper(_text("urgency", "INFO")).alias("urgency"),
        F.upper(_text("sentiment")).alias("sentiment"), _number("greed_index", 50).cast("int").alias("greed_index"),
        _strings("reasoning_chain").alias("reasoning"), _strings("similar_historical_events").alias("similar_events"),
        F.coalesce(F.from_json(F.get_json_object("_j", "$.expected_asset_moves"), "map<string,string>"),
                   F.create_map().cast("map<string,string>")).alias("expected_moves"),
        _text("calibration_note").alias("calibration_note"), _text("flash_note").alias("flash_note"),
        _text("analyst_note").alias("analyst_note"), _strings("key_points").alias("key_points"),
        _strings("risk_flags").alias("risk_flags"))
    good = good.withColumn("low_confidence", F.col("confidence") < 40)
    return good, d.filter("not _ok").select(*df.columns, F.lit("not a JSON object").alias("reject_reason"))


TIMELINESS = ["immediate", "recent", "retrospective_new", "retrospective"]


def parse_event_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Event decisions; an unparsable response is a non-event with a reason."""
    d = _parsed(df, raw)
    way = F.lower(F.trim(_text("direction", "up")))
    when = F.lower(F.trim(_text("timeliness", "immediate")))
    reason = F.trim(F.coalesce(F.get_json_object("_j", "$.filter_reason"), F.get_json_object("_j", "$.reason"), F.lit("")))
    return d.select(
        *df.columns, (_flag("is_event") & F.col("_ok")).alias("is_event"), _ints("event_types").alias("event_types"),
        _number("intensity", 0).cast("int").alias("intensity"), _strings("sector_tags").alias("sector_tags"),
        F.trim(_text("headline_signal")).alias("headline_signal"), _strings("ticker_hint").alias("tickers"),
        F.trim(_text("risk_snapshot")).alias("risk_snapshot"), _flag("notable").alias("notable"),
        F.when(way == "", "up").otherwise(way).alias("direction"), _flag("confirmed").alias("confirmed"),
        F.when(when.isin(TIMELINESS), when).otherwise("immediate").alias("timeliness"),
        F.when(F.col("_ok"), reason).otherwise("JSON parse error").alias("filter_reason"))


def parse_macro_responses(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    d = _parsed(df, raw)
    names = ["indicator", "tier", "actual", "expected", "deviation", "headline_signal", "risk_snapshot"]
    macro = _flag("is_macro")
    good = d.filter("_ok").select(
        *df.columns, macro.alias("is_macro"), *[F.when(macro, _text(n)).otherwise("").alias(n) for n in names],
        F.when(macro, _text("alert_level", "normal")).otherwise("normal").alias("alert_level"))
    return good, d.filter("not _ok").select(*df.columns)


def parse_review_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """verdict, failures (1..5) and note; all null where no valid verdict can be read.

    A response that is not JSON as a whole may contain the object.
    """
    d = _parsed(df, raw)
    inner = F.nullif(F.regexp_extract("_j", r'(?s)(\{[^{}]*"verdict"[^{}]*\})', 1), F.lit(""))
    d = d.withColumn("_j", F.when(F.col("_ok"), F.col("_j")).otherwise(inner))
    verdict = F.upper(F.trim(_text("verdict")))
    raw_list = F.get_json_object("_j", "$.failures")
    listed = raw_list.isNull() | F.trim(raw_list).startswith("[")
    numbers = F.filter(_ints("failures"), lambda v: (v >= 1) & (v <= 5))
    ok = verdict.isin("PUSH", "SILENT", "DROP") & listed & F.try_parse_json("_j").isNotNull()
    return d.select(*df.columns, F.when(ok, verdict).alias("verdict"), F.when(ok, numbers).alias("failures"),
                    F.when(ok, F.substring(_text("note"), 1, 200)).alias("note"))
