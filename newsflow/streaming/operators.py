"""Structured Streaming forms of the live rules.

Rules that depend on order use one keyed fold: rows wait in the key's state until the watermark has
passed them and are then folded in event order, so the result does not depend on how rows arrive
within the lateness. Later rows are dropped (``split_late`` keeps them). State is a JSON document and the
waiting rows per bucket of keys. The step functions are shared with the batch folds, so a stream over the same rows gives the
same decisions for everything the watermark has passed.
"""

from __future__ import annotations

import json
from datetime import date
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_fingerprint, market_session, normalize_url, title_tokens, to_eastern
from ..operators.folds import SIMILAR_HEADLINE, debounce_step, suppression_step  # noqa: F401
from ..operators.scoring import screen
from ..operators.windows import top_per_key

LATENESS = "30 minutes"


def _plain(v):
    """A value of a row as JSON can hold it."""
    if isinstance(v, pd.Timestamp):
        return {"ns": v.value}
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v]
    if isinstance(v, np.generic):
        return v.item()
    return {"day": v.isoformat()} if isinstance(v, date) else v


FOLD_ROWS = 4096
FOLD_BUCKETS = 1024


def keyed_fold(stream: DataFrame, keys: list[str], order: list[str], ts: str, step: Callable[[dict, dict], list[dict]],
               out: T.StructType, quiet_seconds: float | None = None, lateness: str | None = LATENESS) -> DataFrame:
    """Fold each key's rows in event order; ``step(state, row)`` returns output rows.

    Keys are dealt to ``FOLD_BUCKETS`` buckets, since a call per key costs more than most keys' rows. The state of a
    bucket is the rule's memory of each key and the rows that the watermark has not passed, as Arrow columns; only
    ``FOLD_ROWS`` rows at a time become Python objects. A key's memory is dropped ``quiet_seconds`` after its last
    row; without it the memory stays. ``lateness`` None: the stream has its watermark already.
    """
    names = out.fieldNames()
    schema = pa.schema([(f.name, pa.timestamp("ns") if isinstance(f.dataType, T.TimestampType) else to_arrow_type(f.dataType))
                        for f in stream.schema.fields])

    def name_of(values: tuple) -> str:
        return json.dumps([_plain(v) for v in values])

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, held = state.get if state.exists else ("{}", None)
        memories = json.loads(text)  # key: [memory, time of its last row]
        passed = state.getCurrentWatermarkMs()
        parts = [] if held is None else [pa.ipc.read_record_batch(pa.py_buffer(held), schema)]
        if not state.hasTimedOut:
            for batch in batches:
                parts.append(pa.RecordBatch.from_arrays([pa.array(batch[f.name], f.type, from_pandas=True) for f in schema], schema=schema))
        rows = pa.Table.from_batches(parts, schema)
        # a row without a time is before all others
        millis = np.asarray(rows[ts].cast(pa.int64()).fill_null(np.iinfo(np.int64).min)) // 1_000_000
        early = millis < passed
        ready = rows.append_column("\0millis", pa.array(millis)).filter(pa.array(early)).sort_by([(c, "ascending") for c in [*keys, *order]])
        current, entry = None, None
        for first in range(0, len(ready), FOLD_ROWS):
            made = []
            for row in ready.slice(first, FOLD_ROWS).to_pylist():
                at, values = row.pop("\0millis"), tuple(row[k] for k in keys)
                if values != current:
                    current, entry = values, memories.setdefault(name_of(values), [{}, None])
                made.extend(step(entry[0], row))
                entry[1] = at
            if made:
                yield pd.DataFrame(made, columns=names, dtype=object)
        waiting, due = None, []
        if not early.all():
            rest = rows.filter(pa.array(~early)).combine_chunks()
            waiting = rest.to_batches()[0].serialize().to_pybytes()
            due.append(int(millis[~early].min()))
        if quiet_seconds is not None:
            open_ = set() if waiting is None else {name_of(tuple(r.values())) for r in rest.group_by(keys).aggregate([]).select(keys).to_pylist()}
            memories = {k: m for k, m in memories.items() if k in open_ or m[1] + quiet_seconds * 1000 >= passed}
            due.extend(int(m[1] + quiet_seconds * 1000) for k, m in memories.items() if k not in open_)
        if memories or waiting is not None:
            state.update((json.dumps(memories), waiting))
            if due:
                state.setTimeoutTimestamp(max(min(due), passed + 1))
        else:
            state.remove()

    return ((stream.withWatermark(ts, lateness) if lateness else stream)
            .withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(FOLD_BUCKETS))).groupBy("_bucket")
            .applyInPandasWithState(run, out, "memories string, waiting binary", "append", GroupStateTimeout.EventTimeTimeout))


# --- duplicates --------------------------------------------------------------------------------
def stream_dedup(news: DataFrame, ts: str = "captured_at", horizon: str = "24 hours") -> DataFrame:
    """First copy per fingerprint within the horizon. The reader of the sink applies the URL tier
    with append_new, which also covers repeats older than the horizon."""
    df = news.withColumn("fingerprint", content_fingerprint(F.col("title"), F.col("snippet")))
    return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_url_dedup(news: DataFrame, ts: str = "captured_at", horizon: str = "24 hours") -> DataFrame:
    df = news.withColumn("normalized_url", normalize_url(F.col("url")))
    return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["normalized_url"])


def ttl_step(state: dict, now: float, ttl: float) -> bool:
    """Accept when nothing was accepted in the last ``ttl`` seconds."""
    if "last" in state and now - state["last"] < ttl:
        return False
    state["last"] = now
    return True


def stream_ttl_dedup(news: DataFrame, ttl_seconds: int = 4 * 3600, id_col: str = "news_id",
                     ts: str = "captured_at", lateness: str = LATENESS) -> DataFrame:
    """Same title suppressed for four hours since it was last accepted; state lives twice that."""
    keyed = news.select(F.md5(F.col("title").cast("binary")).alias("title_hash"), id_col, ts)
    out = T.StructType([keyed.schema["title_hash"], keyed.schema[id_col], keyed.schema[ts]])

    def step(state, row):
        return [row] if ttl_step(state, row[ts].timestamp(), ttl_seconds) else []

    return keyed_fold(keyed, ["title_hash"], [ts, id_col], ts, step, out, 2 * ttl_seconds, lateness)


# --- events ------------------------------------------------------------------------------------
def cluster_step(recent: list, next_id: int, tokens: set, now: float, window: float, threshold: float):
    """Join the event of the most similar recent article, else pair with a single one.

    ``recent`` holds [id, time, tokens, event], newest first. Returns (event, seed id).
    """
    best_event, best_single = (0.0, None), (0.0, None)
    for entry in recent:
        other = set(entry[2])
        score = len(tokens & other) / len(tokens | other) if tokens and other else 0.0
        if score < threshold:
            continue
        if entry[3] is not None and score > best_event[0]:
            best_event = (score, entry[3])
        if entry[3] is None and score > best_single[0]:
            best_single = (score, entry)
    if best_event[1] is not None:
        return best_event[1], None
    if best_single[1] is not None:
        best_single[1][3] = best_single[1][0]
        return best_single[1][0], best_single[1][0]
    return None, None


def stream_cluster(news: DataFrame, block: Column, window_seconds: int = 1800, threshold: float = 0.45,
                   id_col: str = "news_id", ts: str = "captured_at", lateness: str = LATENESS) -> DataFrame:
    """(news_id, event_id, joined_at) as articles arrive, one greedy clusterer per block.

    The event is named by its first article, which is emitted again when it becomes a seed.
    ``block`` bounds the state; articles of different blocks are not compared.
    """
    keyed = news.select(block.cast("string").alias("block"), id_col, ts,
                        title_tokens(F.coalesce("title", F.lit(""))).alias("tokens"))
    out = T.StructType([T.StructField("block", T.StringType()), keyed.schema[id_col],
                        T.StructField("event_id", T.LongType()), T.StructField("joined_at", T.TimestampType())])

    def step(state, row):
        now, tokens = row[ts].timestamp(), set(row["tokens"])
        recent = [e for e in state.get("recent", []) if now - e[1] <= window_seconds]
        event, seed = cluster_step(recent, 0, tokens, now, window_seconds, threshold)
        state["recent"] = [[int(row[id_col]), now, sorted(tokens), event], *recent]
        made = [] if event is None else [{"block": row["block"], id_col: row[id_col], "event_id": event, "joined_at": row[ts]}]
        if seed is not None:
            made.insert(0, {"block": row["block"], id_col: seed, "event_id": event, "joined_at": row[ts]})
        return made

    return keyed_fold(keyed, ["block"], [ts, id_col], ts, step, out, window_seconds, lateness)


ESCALATION = {"min_sources": 3, "min_peak": 70.0, "vix_pct": 5.0, "spx_pct": 0.2, "brent_pct": 0.5,
              "oil_categories": ["geopolitical", "macro_data"], "silence_hours": 6.0}


def escalation_step(state: dict, row: dict, cfg: dict = ESCALATION) -> str | None:
    """Next state of an event at one sweep, or None when nothing changes.

    row: source_count, peak_impact, category, sentiment, silent_hours, spx_pct, vix_pct, brent_pct
    """
    now = state.get("state", "NONE")
    if now == "NONE":
        if row["source_count"] >= cfg["min_sources"] and row["peak_impact"] >= cfg["min_peak"]:
            state.update(state="ALERTED", category=row["category"], sentiment=row["sentiment"])
            return "ALERTED"
        return None
    if now == "CLOSED":
        return None
    if row["silent_hours"] >= cfg["silence_hours"]:
        state["state"] = "CLOSED"
        return "CLOSED"
    if now != "ALERTED":
        return None
    bearish = "BEAR" in (state.get("sentiment") or "").upper()
    spx, vix, oil = (None if v is None or v != v else v for v in (row["spx_pct"], row["vix_pct"], row["brent_pct"]))
    confirmed = (vix is not None and vix >= cfg["vix_pct"]) or (
        spx is not None and (spx <= -cfg["spx_pct"] if bearish else spx >= cfg["spx_pct"])) or (
        oil is not None and bearish and oil >= cfg["brent_pct"] and state.get("category") in cfg["oil_categories"])
    if confirmed:
        state["state"] = "CONFIRMED"
        return "CONFIRMED"
    return None


ESCALATION_ALERTS = {"ALERTED": "important", "CONFIRMED": "critical", "CLOSED": "normal"}


def stream_escalation(sweeps: DataFrame, ts: str = "swept_at", cfg: dict = ESCALATION, lateness: str = LATENESS,
                      quiet_seconds: float | None = None, tie: str | None = None) -> DataFrame:
    """State changes and alerts of events over their sweep rows (one per event and sweep); an event's
    state is kept unless ``quiet_seconds`` ends it. ``tie`` orders sweeps of one time and is put out too."""
    out = T.StructType([T.StructField("event_id", T.LongType()), T.StructField(ts, T.TimestampType()), *([sweeps.schema[tie]] if tie else []),
                        T.StructField("state", T.StringType()), T.StructField("alert_level", T.StringType())])

    def step(state, row):
        new = escalation_step(state, row, cfg)
        known = {c: row[c] for c in ("event_id", ts, *([tie] if tie else []))}
        return [] if new is None else [{**known, "state": new, "alert_level": ESCALATION_ALERTS[new]}]

    return keyed_fold(sweeps, ["event_id"], [ts] + ([tie] if tie else []), ts, step, out, quiet_seconds, lateness)


# --- suppression -------------------------------------------------------------------------------
def stream_topic_suppression(alerts: DataFrame, window_seconds: int = 24 * 3600, by_intensity: bool = True,
                             ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Pass or skip per recipient. ``alerts``: recipient, id, ts, dedup_key, tokens,
    strategic_tags, intensity. Chat rule: window 300 s, by_intensity False."""
    out = T.StructType([T.StructField("recipient", T.StringType()), T.StructField("id", T.LongType()),
                        T.StructField(ts, T.TimestampType()), T.StructField("passed", T.BooleanType()),
                        T.StructField("suppress_reason", T.StringType())])

    def step(state, row):
        log = {k: (v[0], v[1], set(v[2]), set(v[3])) for k, v in state.get("log", {}).items()}
        ok, why = suppression_step(log, row["dedup_key"], row[ts].timestamp(), int(row["intensity"] or 0),
                                   set(row["strategic_tags"]), set(row["tokens"]), window_seconds, by_intensity)
        state["log"] = {k: [v[0], v[1], sorted(v[2]), sorted(v[3])] for k, v in log.items()}
        return [{"recipient": row["recipient"], "id": row["id"], ts: row[ts], "passed": ok, "suppress_reason": why}]

    return keyed_fold(alerts, ["recipient"], [ts, "id"], ts, step, out, window_seconds, lateness)


def batch_cap(path: str, k: int = 4, order: tuple = ("ts", "id"), channel: str = "channel"):
    """foreachBatch writer: at most k alerts per channel and micro-batch reach the sink. A batch that is
    run again replaces its own folder ``batch_id=<n>``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        top_per_key(batch, [channel], list(order), k).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


# --- health ------------------------------------------------------------------------------------
def ingest_rate(news: DataFrame, width: str = "1 hour", slide: str | None = None, ts: str = "captured_at",
                lateness: str = LATENESS) -> DataFrame:
    """Articles per window; tumbling by default, sliding with ``slide``."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (news.withWatermark(ts, lateness).groupBy(w.alias("w")).agg(F.count("*").alias("articles"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "articles"))


def stall_step(state: dict, failed: bool, threshold: int = 3) -> str | None:
    if failed:
        state["run"] = state.get("run", 0) + 1
        return "source_stall" if state["run"] == threshold else None
    recovered = state.get("run", 0) >= threshold
    state["run"] = 0
    return "source_recovered" if recovered else None


def stream_source_stall(cycles: DataFrame, threshold: int = 3, ts: str = "ts", tie: str = "event_id",
                        lateness: str = LATENESS, quiet_seconds: float | None = None) -> DataFrame:
    out = T.StructType([T.StructField("source", T.StringType()), cycles.schema[tie],
                        T.StructField(ts, T.TimestampType()), T.StructField("event_type", T.StringType())])

    def step(state, row):
        event = stall_step(state, bool(row["failed"]), threshold)
        return [] if event is None else [{"source": row["source"], tie: row[tie], ts: row[ts], "event_type": event}]

    return keyed_fold(cycles, ["source"], [ts, tie], ts, step, out, quiet_seconds, lateness)


def stream_health_alerts(verdicts: DataFrame, n: int = 2, cooldown_seconds: int = 3600, ts: str = "ts",
                         lateness: str = LATENESS, quiet_seconds: float | None = None, tie: str | None = None) -> DataFrame:
    out = T.StructType([T.StructField("pipeline", T.StringType()), T.StructField(ts, T.TimestampType()),
                        T.StructField("alerted", T.BooleanType())])

    def step(state, row):
        hit = debounce_step(state, bool(row["should_alert"]), row[ts].timestamp(), n, cooldown_seconds)
        return [{"pipeline": row["pipeline"], ts: row[ts], "alerted": hit}]

    return keyed_fold(verdicts, ["pipeline"], [ts] + ([tie] if tie else []), ts, step, out, quiet_seconds, lateness)


# --- joins and enrichment ------------------------------------------------------------------------
def stream_outcome_windows(assess: DataFrame, prices: DataFrame, tolerance: str = "10 minutes",
                           symbol: str = "symbol", tie: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """One row per assessment and window (15 min, 1 h, 4 h): the first bar from the due time on within the
    tolerance, or nulls when the watermark has passed it without one.

    A due time lies in one slot of its symbol, six times as long as the tolerance; a bar goes to its own slot and,
    near its start, to the one before. Each slot is folded in time order, so a bar meets only the due times that
    still wait, not all of its symbol (``tie`` orders bars of one time). An assessment later than ``lateness`` loses the windows that the
    watermark has passed.
    """
    seconds = pd.Timedelta(tolerance).total_seconds()
    micros = int(seconds * 1_000_000)

    def slot(at: Column, back: int = 0) -> Column:
        t = F.unix_micros(at) - back
        return t - F.pmod(t, F.lit(6 * micros))

    fields = {"id": assess.schema["id"].dataType, "tie": prices.schema[tie].dataType if tie else T.IntegerType()}
    filler = {n: F.lit(0).cast(t).alias(n) for n, t in fields.items()}  # no nulls: they would turn ids into doubles
    bars = (prices.withWatermark("ts", lateness).filter(F.col("ts").isNotNull() & F.col(symbol).isNotNull())
            .select(F.col("ts").alias("at"), symbol, F.lit(1).alias("kind"), filler["id"], F.lit("").alias("window"),
                    F.col(tie).alias("tie") if tie else filler["tie"], F.col("close").cast("string").alias("close"),
                    F.explode(F.array_distinct(F.array(slot(F.col("ts")), slot(F.col("ts"), micros)))).alias("slot")))
    due = (assess.withWatermark("created_at", lateness).filter(F.col("created_at").isNotNull()).select("id", symbol, F.explode(F.array(*[
        F.struct(F.lit(n).alias("window"), (F.col("created_at") + F.expr(f"INTERVAL {m} MINUTES")).alias("due"))
        for n, m in (("15m", 15), ("1h", 60), ("4h", 240))])).alias("w")).select("id", symbol, "w.*"))
    # a due time begins to wait before the bars of its time and ends after those of its last
    ends = F.explode(F.array(F.struct(F.col("due").alias("at"), F.lit(0).alias("kind")),
                             F.struct((F.col("due") + F.expr(f"INTERVAL {tolerance}")).alias("at"), F.lit(2).alias("kind"))))
    marks = (due.select("id", symbol, "window", slot(F.col("due")).alias("slot"), ends.alias("e"))
             .select("e.at", symbol, "e.kind", "id", "window", filler["tie"], F.lit(None).cast("string").alias("close"), "slot"))
    out = T.StructType([T.StructField("id", fields["id"]), T.StructField("window", T.StringType()), T.StructField(symbol, assess.schema[symbol].dataType),
                        T.StructField("due", T.TimestampType()), T.StructField("bar_ts", T.TimestampType()), T.StructField("close", T.StringType())])

    def step(state, row):
        if row["kind"] == 0:
            state.setdefault("open", []).append([_plain(row["id"]), row["window"], row["at"].value])
            return []
        met = state.get("open", [])
        if row["kind"] == 1:
            found = {"bar_ts": row["at"], "close": row["close"]}
            state["open"] = []
        else:
            found = {"bar_ts": None, "close": None}
            gone = row["at"].value - micros * 1000
            met = [o for o in met if o[2] <= gone]
            state["open"] = [o for o in state.get("open", []) if o[2] > gone]
        return [{"id": i, "window": w, symbol: row[symbol], "due": pd.Timestamp(at), **found} for i, w, at in met]

    made = keyed_fold(bars.unionByName(marks), [symbol, "slot"], ["at", "kind", "tie"], "at", step, out, 7 * seconds, None)
    return made.withColumn("close", F.col("close").cast(prices.schema["close"].dataType))


def stream_enrich(news: DataFrame, **kw) -> DataFrame:
    """The screening stage on a stream; it is stateless, so the batch operator serves."""
    return screen(news, **kw)


def enrich_batches(path: str, **kw):
    """foreachBatch writer of the screening stage: a headline that many rows of a micro-batch share is scored once.
    A batch that is run again replaces its own folder ``batch_id=<n>``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        screen(batch, **kw).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


SNAPSHOTS = {"pre": (9 * 60 + 25, 9 * 60 + 35), "intraday": (14 * 60 + 30, 14 * 60 + 40), "sector": (16 * 60 + 30, 16 * 60 + 40)}


def stream_snapshot_windows(quotes: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Earliest quote per ticker inside each daily snapshot window (New York time, weekdays)."""
    et = to_eastern(F.col(ts))
    minute = F.hour(et) * 60 + F.minute(et)
    name = None
    for label, (lo, hi) in SNAPSHOTS.items():
        name = F.when(minute.between(lo, hi), label) if name is None else name.when(minute.between(lo, hi), label)
    df = (quotes.withWatermark(ts, lateness).withColumn("snapshot", name).filter(F.col("snapshot").isNotNull() & ~F.dayofweek(et).isin(1, 7))
          .withColumn("day", et.cast("date")))

    def step(state, row):
        new = "taken" not in state
        state["taken"] = True
        return [row] if new else []

    return keyed_fold(df, ["ticker", "snapshot", "day"], [ts], ts, step, df.schema, 24 * 3600, None)


def with_session(quotes: DataFrame, ts: str = "ts") -> DataFrame:
    return quotes.withColumn("session", market_session(F.col(ts)))


def split_late(batch_ts: str, watermark_seconds: float, table: str, late_table: str):
    """foreachBatch writer that sends rows behind the batch's watermark to a side table; a
    batch that is run again replaces its own folders."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(batch_ts).alias("m")).first()["m"]
        if newest is None:
            return
        bound = F.lit(newest) - F.make_dt_interval(secs=F.lit(float(watermark_seconds)))
        batch.filter(F.col(batch_ts) >= bound).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        batch.filter(F.col(batch_ts) < bound).write.mode("overwrite").parquet(f"{late_table}/batch_id={batch_id}")
    return write
