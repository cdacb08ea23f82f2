"""Alert levels: classification, event channels, macro matrix, review, gates, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import entities as E

LEVELS = ["normal", "notable", "important", "critical"]


def classify_alert(df: DataFrame, impact: str = "impact_score", confidence: str = "confidence",
                   urgency: str = "urgency", strategic: str = "strategic", rel: str = "rel_mult",
                   timeliness: str = "timeliness") -> DataFrame:
    """Adds ``level`` and ``reason``.

    Rows with an assessment follow its urgency (or the weighted composite when it has none);
    rows without one follow strategic matches and the priority score. Then the watch-list gate
    demotes untracked stock news and the timeliness gate marks stale news as phone-blocked.
    """
    c = F.col
    scored = c(impact).isNotNull()
    composite = F.round((c(impact) * 0.7 + c(confidence) * 0.3) * c(rel), 1)
    detail = F.format_string(": impact=%.0f conf=%.0f", c(impact).cast("double"), c(confidence).cast("double"))

    def said(level: str, word: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.concat(F.lit(f"LLM {word}"), detail).alias("reason"))

    def plain(level: str, reason: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), reason.alias("reason"))

    comp = F.format_string("composite=%.1f", composite)
    with_assessment = (
        F.when(c(urgency) == "FLASH", said("critical", "FLASH")).when(c(urgency) == "ALERT", said("important", "ALERT"))
        .when(c(urgency) == "WATCH", said("normal", "WATCH")).when(c(urgency) == "INFO", said("normal", "INFO"))
        .when(composite >= 55, plain("critical", comp)).when(composite >= 50, plain("important", comp))
        .otherwise(plain("normal", comp)))
    gov = F.exists(strategic, lambda m: m["category"] == "gov_intervention")
    firm = F.exists(strategic, lambda m: m["category"].startswith("nvda_") & (m["conf"] >= 0.70))
    tracked = c(rel) > 0.5
    score = c("priority_score")
    text = F.format_string("priority_score=%.2f", score)
    without = (F.when(gov, plain("critical", F.lit("gov_intervention match")))
               .when(firm, plain("critical", F.lit("nvda strategic event")))
               .when(score >= 0.55, plain("critical", text))
               .when(score >= F.when(tracked, 0.35).otherwise(0.50), plain("important", text))
               .otherwise(plain("normal", F.lit("routine news"))))
    base = F.when(scored, with_assessment).otherwise(without)
    final_already = ~scored & (gov | firm | (base["level"] == "normal"))
    bypass = F.exists(strategic, lambda m: m["category"].isin(
        "gov_intervention", "nvda_investment", "nvda_endorsement") & (m["conf"] >= 0.70))
    untracked_stock = c("has_tickers") & ~c("is_macro") & ~tracked
    stale = c(timeliness).isNotNull() & (c(timeliness) < 0.25) & ~c("is_breaking") & ~c("is_macro")
    was = F.concat(F.lit(" (was: "), F.col("_b.reason"), F.lit(")"))
    picked = (F.when(final_already | bypass, F.col("_b"))
              .when(untracked_stock & (F.col("_b.level") != "normal"),
                    plain("normal", F.concat(F.lit("not_in_watchlist"), was)))
              .when(stale, F.struct(F.col("_b.level").alias("level"), F.concat(
                  F.lit("phone_blocked:low_timeliness"), was).alias("reason")))
              .otherwise(F.col("_b")))
    return (df.withColumn("_b", base).withColumn("_p", picked)
            .withColumn("level", F.col("_p.level")).withColumn("reason", F.col("_p.reason")).drop("_b", "_p"))


def channel_level(intensity: Column, direction: Column, confirmed: Column, losers: Column, tracked,
                  event_types: Column) -> Column:
    """Direction-aware level of an event decision; errs toward silence."""
    way = F.lower(F.trim(F.coalesce(direction, F.lit(""))))
    opinion = (F.size(event_types) > 0) & (F.size(F.array_except(event_types, F.array(F.lit(3)))) == 0)
    held = tracked if isinstance(tracked, Column) else F.array(*[F.lit(t) for t in tracked]).cast("array<string>")
    hit = F.coalesce(F.size(F.array_intersect(losers, held)), F.lit(0)) > 0
    return (F.when(intensity < 3, "normal").when(intensity == 3, "notable")
            .when(opinion, F.when(intensity >= 5, "critical").otherwise("notable"))
            .when(way == "down", F.when(~F.coalesce(confirmed, F.lit(False)), "notable")
                  .when(hit, "critical").otherwise("important"))
            .when(way == "up", F.when(intensity >= 5, "critical").otherwise("important"))
            .otherwise("important"))


def _upper_all(c: Column) -> Column:
    return F.filter(F.transform(c, lambda t: F.upper(F.trim(t))), lambda t: t != "")


def apply_event_decision(df: DataFrame, tracked=(), stale_minutes: float = 60) -> DataFrame:
    """Caps intensity by timeliness, raises it for multi-source events, maps the level and
    silences stale single-source alerts. Needs source_count and age_minutes of the event."""
    cap = F.when(F.col("timeliness") == "retrospective", 2).when(F.col("timeliness") == "retrospective_new", 3).otherwise(99)
    sources = F.coalesce("source_count", F.lit(0))
    capped = F.least("intensity", cap)
    strength = F.when((sources >= 3) & (capped < 5), capped + 1).otherwise(capped)
    out = df.withColumn("final_intensity", strength)
    level = channel_level(F.col("final_intensity"), F.col("direction"), F.col("confirmed"),
                          _upper_all(F.col("tickers")), tracked, F.col("event_types"))
    return (out.withColumn("alert_level", downgrade_if_stale(level, F.col("age_minutes"), sources >= 3, stale_minutes))
            .withColumn("needs_deep", F.col("final_intensity") >= 4)
            .withColumn("signal_score", F.col("final_intensity") / 5.0)
            .withColumn("impact_score", F.col("final_intensity") * 20))


def downgrade_if_stale(level: Column, age_minutes: Column, multi_source: Column, limit: float = 60) -> Column:
    stale = (level == "important") & ~multi_source & F.coalesce(age_minutes > limit, F.lit(False))
    return F.when(stale, "notable").otherwise(level)


def rescue_level(df: DataFrame, tracked=()) -> DataFrame:
    """Level of non-events: notable for a notable action on a tracked ticker or a high impact."""
    held = F.array(*[F.lit(t) for t in tracked]).cast("array<string>")
    saved = ~F.col("is_event") & F.coalesce("notable", F.lit(False)) & F.coalesce(
        F.arrays_overlap(_upper_all(F.col("tickers")), held), F.lit(False))
    impact = F.coalesce(F.col("impact_score").cast("int"), F.lit(0))
    return (df.withColumn("alert_level", F.when(saved | (impact >= 80), "notable").otherwise("normal"))
            .withColumn("rescued_by", F.when(saved, "watchlist").when(impact >= 80, "impact"))
            .withColumn("needs_deep", (impact >= 60) | F.coalesce(F.col("urgency").isin("FLASH", "ALERT"), F.lit(False))))


def macro_level(tier: Column, deviation: Column, table=E.MACRO_LEVELS) -> Column:
    cells = F.create_map(*[x for (t, d), level in table.items() for x in (F.lit(f"{t}/{d}"), F.lit(level))])
    return F.coalesce(F.try_element_at(cells, F.concat_ws("/", tier, deviation)), F.lit("normal"))


def apply_review(df: DataFrame, level: str = "alert_level", failures: str = "failures") -> DataFrame:
    """Three failures silence an alert, two make it quiet; a missing verdict keeps it."""
    n = F.coalesce(F.size(failures), F.lit(0))
    new = (F.when(F.col(level) == "normal", F.col(level)).when(F.col(failures).isNull(), F.col(level))
           .when(n >= 3, "normal").when(n >= 2, "notable").otherwise(F.col(level)))
    return df.withColumn("reviewed_level", new)


def phone_gate(level: Column, tags: Column, impact: Column, minimum: int = 92) -> Column:
    """Important alerts reach the phone with a strategic tag or as a macro shock."""
    strategic = F.coalesce(F.exists(tags, lambda t: F.trim(t).startswith("STRATEGIC_")), F.lit(False))
    shock = (F.coalesce(F.size(tags), F.lit(0)) > 0) & (F.coalesce(impact, F.lit(0)) >= minimum)
    return F.when(level == "important", strategic | shock).otherwise(level == "critical")


def health_verdict(df: DataFrame, success_floor: float = 50.0, minimum: int = 5) -> DataFrame:
    """Adds state, should_alert and emergency; the first applicable rule decides."""
    c = F.col
    stalled = (c("ingest_floor") > 0) & (c("ingest_1h") <= 0)
    idle = ((c("ingest_1h") > 0) & (c("assessments_1h") == 0) & (c("hours_since_push") > 4)
            & (c("ingest_1h") >= c("ingest_floor")))
    failing = (c("assessments_1h") >= minimum) & (c("success_rate") < success_floor)
    state = (F.when(stalled, "stalled").when(F.size("stalled") > 0, "degraded").when(idle, "degraded")
             .when(failing, "degraded").when(c("ingest_1h") < c("ingest_floor"), "quiet_ok").otherwise("healthy"))
    return (df.withColumn("state", state).withColumn("should_alert", F.col("state").isin("stalled", "degraded"))
            .withColumn("emergency", F.col("state") == "stalled"))


def ingest_floor(ts: Column, floor: int = 3, weekend: float = 0.34) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), max(1, int(floor * weekend))).otherwise(floor)
