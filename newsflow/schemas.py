"""Table schemas of the domain model; readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _l, _i = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
_ts, _dt, _b = T.TimestampType(), T.DateType(), T.BooleanType()
_as, _al, _ai = T.ArrayType(_s), T.ArrayType(_l), T.ArrayType(_i)


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


NEWS = _schema(
    news_id=_l, title=_s, url=_s, source=_s, snippet=_s, published_at=_ts, captured_at=_ts,
    tickers=_as, macro_tags=_as, is_breaking=_b, priority_score=_d, sentiment=_s,
    sentiment_score=_d, event_id=_l, status=_s,
)
EVENT_LINES = _schema(
    event_id=_l, title=_s, member_ids=_al, source_count=_i, first_seen=_ts, last_updated=_ts,
    is_active=_b, state=_s, peak_impact=_d, category=_s, sentiment=_s, alerted_at=_ts,
)
ASSESSMENTS = _schema(
    id=_l, news_id=_l, impact_score=_d, confidence=_d, category=_s, breadth=_s, urgency=_s,
    sentiment=_s, reasoning=_as, expected_moves=T.MapType(_s, _s), version=_s, created_at=_ts,
)
OUTCOMES = _schema(
    assessment_id=_l, window=_s, spx_pct=_d, vix_pct=_d, sector_changes=T.MapType(_s, _d),
    actual_score=_d, collected_at=_ts,
)
EVENT_DECISIONS = _schema(
    news_id=_l, is_event=_b, event_types=_ai, intensity=_i, direction=_s, confirmed=_b,
    timeliness=_s, sector_tags=_as, tickers=_as, notable=_b, filter_reason=_s,
    headline_signal=_s, alert_level=_s,
)
FUND_FLOW = _schema(
    ticker=_s, date=_dt, main_net=_d, main_in_flow=_d, super_net=_d, big_net=_d, mid_net=_d,
    small_net=_d, main_pct=_d, close=_d, change_pct=_d,
)
FEEDBACK = _schema(news_id=_l, reaction=_s, ts=_ts)
HEALTH_EVENTS = _schema(event_type=_s, detail=_s, created_at=_ts)
ALERTS = _schema(
    id=_l, ts=_ts, title=_s, headline=_s, tickers=_as, intensity=_i, direction=_s, level=_s,
    impact=_i, macro_tags=_as,
)
QUOTES = _schema(
    ticker=_s, name=_s, last=_d, prev_close=_d, change_rate=_d, volume=_l, turnover_rate=_d,
)
HISTORY = _schema(
    date=_s, text=_s, level=_s, score=_i, reaction=_s, tickers=_as, tags=_as, category=_s,
)
CASES = _schema(
    case_id=_s, title=_s, catalyst_types=_ai, intensity=_i, direction=_s, beneficiaries=_as,
    linked_tickers=_as, sector_etf=_as, is_push=_b, alert_level=_s,
)
