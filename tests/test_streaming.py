"""State machines step by step, and streams against their batch form."""

import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsflow.operators import folds as O
from newsflow.streaming import operators as S

T0 = datetime(2024, 1, 1)


def drain(spark, tmp_path, stream):
    name = "t" + uuid.uuid4().hex
    q = (stream.writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name).collect()


def source(spark, tmp_path, df, ts=None, end=None, arrivals=1):
    """A stream of ``arrivals`` micro-batches over shuffled rows, and a row far ahead that lets the watermark pass all."""
    path = str(tmp_path / ("s" + uuid.uuid4().hex))
    rows = df.collect()
    random.Random(4).shuffle(rows)
    parts = [rows[i::arrivals] for i in range(arrivals)]
    if ts:  # the row that ends the stream
        parts.append([df.filter(F.col(ts) == df.agg(F.max(ts)).first()[0]).limit(1).withColumn(ts, F.lit(end)).withColumns(
            {f.name: F.lit("end").cast(f.dataType) for f in df.schema.fields if f.name in ("recipient", "block_of", "source", "pipeline")}).first()])
    for part in parts:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_escalation_end_to_end(spark, tmp_path):
    rows = [(1, T0, 2, 95.0, 0.0, None, None, None), (1, T0 + timedelta(minutes=5), 3, 95.0, 0.0, None, None, None),
            (1, T0 + timedelta(minutes=10), 3, 95.0, 0.0, 0.5, None, None), (1, T0 + timedelta(minutes=15), 3, 95.0, 0.0, -0.5, None, None),
            (1, T0 + timedelta(hours=8), 3, 95.0, 7.0, None, None, None), (1, T0 + timedelta(hours=9), 3, 95.0, 8.0, None, None, None)]
    df = spark.createDataFrame([(*r[:4], "geopolitical", "BEARISH", *r[4:]) for r in rows],
                               "event_id long, swept_at timestamp, source_count int, peak_impact double, category string, sentiment string, silent_hours double, spx_pct double, vix_pct double, brent_pct double")
    got = sorted((r["swept_at"], r["state"], r["alert_level"]) for r in drain(spark, tmp_path, S.stream_escalation(source(spark, tmp_path, df, 'swept_at', T0 + timedelta(days=9), 3), lateness='10 hours')))
    assert [g[1:] for g in got] == [("ALERTED", "important"), ("CONFIRMED", "critical"), ("CLOSED", "normal")]


def test_suppression_stream_equals_batch(spark, tmp_path):
    rows = [(f"r{i % 2}", i, T0 + timedelta(minutes=17 * i), f"k{i % 5}", i % 4, [f"w{i % 7}", f"w{i % 3}"], ["STRATEGIC_A"] if i % 6 == 0 else []) for i in range(60)]
    df = spark.createDataFrame(rows, "recipient string, id long, ts timestamp, dedup_key string, intensity int, tokens array<string>, strategic_tags array<string>")
    want = {r["id"]: r["passed"] for r in O.suppress_topics(df).collect()}
    got = {r["id"]: r["passed"] for r in drain(spark, tmp_path, S.stream_topic_suppression(source(spark, tmp_path, df, 'ts', T0 + timedelta(days=9), 4), lateness='20 hours')) if r['recipient'] != 'end'}
    assert got == want and len(set(want.values())) == 2


def test_cluster_stream(spark, tmp_path):
    rows = [(1, "fed cuts rates today", 0), (2, "fed cuts rates today now", 5), (3, "apple opens store", 6), (4, "fed cuts rates today", 7), (5, "fed cuts rates today", 90)]
    df = spark.createDataFrame([(i, t, T0 + timedelta(minutes=m)) for i, t, m in rows], "news_id long, title string, captured_at timestamp")
    got = sorted((r["news_id"], r["event_id"]) for r in drain(spark, tmp_path, S.stream_cluster(source(spark, tmp_path, df, 'captured_at', T0 + timedelta(days=9), 3), F.lit("all"), lateness='3 hours')))
    assert got == [(1, 1), (2, 1), (4, 1)]


def test_outcome_windows_and_snapshots(spark, tmp_path):
    a = spark.createDataFrame([(1, "SPX", T0)], "id long, symbol string, created_at timestamp")
    p = spark.createDataFrame([("SPX", T0 + timedelta(minutes=m), float(m)) for m in (5, 20, 16, 61, 69, 251)], "symbol string, ts timestamp, close double")
    far = T0 + timedelta(days=9)
    rows = drain(spark, tmp_path, S.stream_outcome_windows(source(spark, tmp_path, a, "created_at", far), source(spark, tmp_path, p, "ts", far, 3), lateness="5 hours"))
    assert sorted((r["window"], r["close"]) for r in rows) == [("15m", 16.0), ("1h", 61.0), ("4h", None)]  # the first bar, or a row without one
    et = datetime(2024, 1, 2, 14, 26)  # 09:26 in New York
    q = spark.createDataFrame([("A", et, 1.0), ("A", et + timedelta(minutes=3), 2.0), ("A", et + timedelta(hours=1), 3.0), ("B", et, 4.0)], "ticker string, ts timestamp, last double")
    rows = drain(spark, tmp_path, S.stream_snapshot_windows(source(spark, tmp_path, q, 'ts', datetime(2024, 1, 12, 20), 3), lateness='2 hours'))
    assert sorted((r["ticker"], r["snapshot"], r["last"]) for r in rows) == [("A", "pre", 1.0), ("B", "pre", 4.0)]  # the earliest quote, whatever arrives first


def test_outcome_windows_do_not_pair_a_symbol_with_all_its_bars(spark, tmp_path):
    """Many bars at few times: the first by (time, tie) or none, without a join on the symbol."""
    draw = random.Random(7)
    marks = [(i, "AB"[i % 2], T0 + timedelta(seconds=draw.randrange(0, 7200, 60))) for i in range(40)]
    bars = [("AB"[i % 2], T0 + timedelta(seconds=draw.randrange(900, 24000, 300)), float(i), i) for i in range(150)]
    far = T0 + timedelta(days=9)
    a = spark.createDataFrame(marks, "id long, symbol string, created_at timestamp")
    p = spark.createDataFrame(bars, "symbol string, ts timestamp, close double, tie long")
    stream = S.stream_outcome_windows(source(spark, tmp_path, a, "created_at", far, 3), source(spark, tmp_path, p, "ts", far, 3), tie="tie", lateness="8 hours")
    assert " Join " not in stream._jdf.queryExecution().analyzed().toString()
    got = sorted((r["id"], r["window"], r["close"]) for r in drain(spark, tmp_path, stream))
    want = []
    for i, symbol, at in marks:
        for name, minutes in (("15m", 15), ("1h", 60), ("4h", 240)):
            due = at + timedelta(minutes=minutes)
            met = [(ts, tie, close) for s, ts, close, tie in bars if s == symbol and due <= ts <= due + timedelta(minutes=10)]
            want.append((i, name, min(met)[2] if met else None))
    assert got == sorted(want) and None in [w[2] for w in want]


def test_batch_cap_and_late_split(spark, tmp_path):
    df = spark.createDataFrame([("tg", i, T0 + timedelta(minutes=i)) for i in range(9)], "channel string, id long, ts timestamp")
    out = str(tmp_path / "capped")
    S.batch_cap(out)(df, 0)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    S.batch_cap(out)(df, 0)  # a batch that is run again
    assert spark.read.parquet(out).count() == 4
    S.split_late("ts", 300, str(tmp_path / "ok"), str(tmp_path / "late"))(df, 0)
    assert spark.read.parquet(str(tmp_path / "late")).count() == 3


def test_screened_batches_equal_the_rows(spark, tmp_path):
    from newsflow.operators.scoring import screen
    df = spark.createDataFrame([(i, ("BREAKING: CPI rose 30% vs 20% expected", "Nvidia beats estimates", "quiet day")[i % 3], "", "CNBC") for i in range(30)],
                               "news_id long, title string, snippet string, source string")
    for again in range(2):
        S.enrich_batches(str(tmp_path / "screened"))(df, 0)
    got = spark.read.parquet(str(tmp_path / "screened")).select("news_id", "priority_score").collect()
    want = screen(df).select("news_id", "priority_score").collect()
    assert sorted(got) == sorted(want) and len(got) >= 10


def test_health_alert_step():
    state, fired = {}, []
    for minute, bad in [(0, True), (30, True), (60, True), (95, True), (120, False), (150, True), (180, True)]:
        fired.append(O.debounce_step(state, bad, minute * 60.0, 2, 3600.0))
    assert fired == [False, True, False, True, False, False, True]


def test_stalls_do_not_depend_on_arrival(spark, tmp_path):
    """Failures at 0, 1, 3 minutes and a healthy cycle at 2 that arrives later: no stall, as in the batch form."""
    df = spark.createDataFrame([("a", i, T0 + timedelta(minutes=m), bad) for i, (m, bad) in enumerate([(0, True), (1, True), (3, True), (2, False), (4, True), (5, True), (6, False)])],
                               "source string, event_id long, ts timestamp, failed boolean")
    path = str(tmp_path / "late")
    for rows in (df.filter("event_id <> 3 and event_id < 5"), df.filter("event_id = 3 or event_id >= 5"),
                 spark.createDataFrame([("end", 99, T0 + timedelta(hours=5), False)], df.schema)):
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r["event_id"], r["event_type"]) for r in drain(spark, tmp_path, S.stream_source_stall(stream)))
    assert got == [(5, "source_stall"), (6, "source_recovered")]


def test_keys_of_a_fold_share_state_rows(spark, tmp_path, monkeypatch):
    """Sixty keys in three buckets, folded a few rows at a time: the rule holds per key, the state is one row per bucket."""
    monkeypatch.setattr(S, "FOLD_BUCKETS", 3)
    monkeypatch.setattr(S, "FOLD_ROWS", 5)
    rng = random.Random(8)
    rows = [(None if i % 60 == 7 else f"t{i % 60}", i, T0 + timedelta(minutes=rng.randrange(3000))) for i in range(400)]
    df = spark.createDataFrame(rows, "title string, news_id long, captured_at timestamp")
    want, last = set(), {}
    for title, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if title not in last or (at - last[title]).total_seconds() >= 4 * 3600:
            last[title] = at
            want.add(i)
    stream = S.stream_ttl_dedup(source(spark, tmp_path, df, "captured_at", T0 + timedelta(days=9), 4), lateness="60 hours")
    q = (stream.writeStream.outputMode("append").format("memory").queryName("shared_state")
         .option("checkpointLocation", str(tmp_path / "shared")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r["news_id"] for r in spark.table("shared_state").collect()} == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3
