"""Streaming operators run over the given tables to the end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import views as V
from ..runtime import shared_dir
from ..sinks.tables import delete_path
from ..streaming import operators as S
from .queries_text import SCREENED_SQL
from .registry import query


def _drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up; the result is written to and read from the shared
    folder, the stream's own state is deleted."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    delete_path(spark, base + "/checkpoint")
    return spark.read.schema(stream.schema).parquet(base + "/out")


def _source(spark: SparkSession, d: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    # as a pattern the path may be a file or a folder of files; a plain path must be a folder
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]")


SLICES, FILES = 4, 4
# the second of a row's arrival, up to 20 minutes late, and the micro-batch it comes with
ARRIVAL = "(epoch(ts)::BIGINT + (event_id * 7919) % 1200)"
SLICE = f"least(({ARRIVAL} - min({ARRIVAL}) OVER ()) * {SLICES} // (max({ARRIVAL}) OVER () - min({ARRIVAL}) OVER () + 1), {SLICES - 1})"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of micro-batches whose rows arrive up to 20 minutes late and out of order.

    The replay ends with a row of event_id -1 ten days later: it lets the watermark pass all events and
    itself stays in the state.
    """
    e = V.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.rint(F.col("ts").cast("double")).cast("bigint") + F.pmod(F.col("event_id") * 7919, F.lit(1200))  # rounded like ARRIVAL
    lo, hi, newest = e.agg(F.min(arrival), F.max(arrival), F.max("ts")).first()
    part = F.least(F.floor((arrival - (lo or 0)) * SLICES / max(1, (hi or 0) - (lo or 0) + 1)), F.lit(SLICES - 1))
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    for n in range(SLICES):  # one after the other: files are read in the order of their times
        e.filter(part == n).repartition(FILES).write.mode("append").parquet(path)
    if newest is not None:
        end = e.limit(1).withColumns({"event_id": F.lit(-1).cast(e.schema["event_id"].dataType), "user_id": F.lit(-1).cast(e.schema["user_id"].dataType),
                                      "ts": F.lit(newest) + F.expr("INTERVAL 10 DAYS")})
        end.write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query(f"""WITH v_cycles AS ({V.VIEW_SQL['v_cycles']}), t AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY source ORDER BY ts, event_id) AS g FROM v_cycles),
 s AS (SELECT *, CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY source, g ORDER BY ts, event_id) ELSE 0 END AS streak FROM t),
 p AS (SELECT *, coalesce(lag(streak) OVER (PARTITION BY source ORDER BY ts, event_id), 0) AS before FROM s)
 SELECT source, event_id, CASE WHEN streak = 3 THEN 'source_stall' ELSE 'source_recovered' END AS event_type FROM p WHERE (streak = 3 OR (NOT failed AND before >= 3))""")
def stream_source_stalls(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    c = e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), "ts", "event_id",
                 F.col("event_type").isin("error", "view", "click").alias("failed"))
    return _drain(spark, S.stream_source_stall(c)).select("source", "event_id", "event_type")


@query(f"""WITH RECURSIVE v AS MATERIALIZED (SELECT md5('v' || CAST(user_id AS VARCHAR)) AS title_hash, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f(title_hash, k, last, ok) AS (SELECT DISTINCT title_hash, 0::BIGINT, TIMESTAMP '1970-01-01', false FROM v UNION ALL
 SELECT v.title_hash, v.k, CASE WHEN epoch(v.ts) - epoch(f.last) >= 43200 THEN v.ts ELSE f.last END, epoch(v.ts) - epoch(f.last) >= 43200 FROM f JOIN v ON v.title_hash = f.title_hash AND v.k = f.k + 1)
 SELECT v.title_hash, v.event_id FROM f JOIN v ON v.title_hash = f.title_hash AND v.k = f.k WHERE f.ok""")
def stream_ttl_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("title"), "event_id", "ts")
    return _drain(spark, S.stream_ttl_dedup(e, 43200, "event_id", "ts")).select("title_hash", "event_id")


@query(f"""WITH RECURSIVE v AS MATERIALIZED (SELECT 'p' || CAST(user_id % 20 AS VARCHAR) AS pipeline, ts, event_type IN ('error', 'view', 'click') AS bad, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events),
 f(pipeline, k, ts, run, last, hit) AS (SELECT DISTINCT pipeline, 0::BIGINT, TIMESTAMP '1970-01-01', 0, TIMESTAMP '1970-01-01', false FROM v UNION ALL
 SELECT v.pipeline, v.k, v.ts, CASE WHEN v.bad THEN f.run + 1 ELSE 0 END, CASE WHEN v.bad AND f.run + 1 >= 2 AND epoch(v.ts) - epoch(f.last) >= 3600 THEN v.ts ELSE f.last END,
 v.bad AND f.run + 1 >= 2 AND epoch(v.ts) - epoch(f.last) >= 3600 FROM f JOIN v ON v.pipeline = f.pipeline AND v.k = f.k + 1)
 SELECT pipeline, count(*) AS verdicts, sum(hit::INT) AS alerts FROM f WHERE k > 0 GROUP BY pipeline""")
def stream_health_alerts(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("pipeline"), "ts", "event_id",
                                 F.col("event_type").isin("error", "view", "click").alias("should_alert"))
    out = _drain(spark, S.stream_health_alerts(e, tie="event_id"))
    return out.groupBy("pipeline").agg(F.count("*").alias("verdicts"), F.sum(F.col("alerted").cast("int")).alias("alerts"))


@query(f"""WITH s AS (SELECT CAST(user_id % 50 AS VARCHAR) AS ticker, ts, event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS et FROM events),
 w AS (SELECT *, extract(hour FROM et) * 60 + extract(minute FROM et) AS m FROM s WHERE dayofweek(et) NOT IN (0, 6)),
 n AS (SELECT *, CASE WHEN m BETWEEN 565 AND 575 THEN 'pre' WHEN m BETWEEN 870 AND 880 THEN 'intraday' WHEN m BETWEEN 990 AND 1000 THEN 'sector' END AS snapshot FROM w)
 SELECT ticker, snapshot, CAST(et AS DATE) AS day, min(ts) AS ts FROM n WHERE snapshot IS NOT NULL GROUP BY 1, 2, 3""")
def stream_snapshots(spark: SparkSession, d: str) -> DataFrame:
    q = _events(spark, d).select((F.col("user_id") % 50).cast("string").alias("ticker"), "ts")
    return _drain(spark, S.stream_snapshot_windows(q)).select("ticker", "snapshot", "day", "ts")


@query("""SELECT date_trunc('hour', ts) AS window_start, count(*) AS articles FROM events GROUP BY 1""")
def stream_ingest_rate(spark: SparkSession, d: str) -> DataFrame:
    """Windows closed by the watermark, which passes all events at the end."""
    e = _events(spark, d).select(F.col("ts").alias("captured_at"))
    return _drain(spark, S.ingest_rate(e)).select("window_start", "articles")


@query("SELECT count(DISTINCT split_part(text, chr(10), 1) || '|' || text) AS articles FROM documents")
def stream_dedup_count(spark: SparkSession, d: str) -> DataFrame:
    docs = _source(spark, d, "documents").filter(F.col("text").isNotNull())  # no text, no article
    n = docs.select(F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("snippet"),
                    F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 1440).alias("captured_at"))
    return _drain(spark, S.stream_dedup(n).select("fingerprint")).agg(F.count("*").alias("articles"))


@query(SCREENED_SQL)
def stream_screened_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Screening on a stream of headlines, batch by batch."""
    base = f"{shared_dir(spark)}/screened-{uuid.uuid4().hex}"
    q = (V.headlines_of(_source(spark, d, "lineitem")).writeStream.foreachBatch(S.enrich_batches(base + "/out"))
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    delete_path(spark, base + "/checkpoint")
    s = spark.read.parquet(base + "/out")
    return s.select("news_id", "priority_score", "filter_multiplier", F.array_join("macro_tags", ",").alias("tags"), F.array_join("tickers", ",").alias("tickers"))


@query(f"""WITH a AS (SELECT event_type AS channel, event_id, ts, {SLICE} AS slice FROM events)
 SELECT channel, event_id FROM (SELECT *, row_number() OVER (PARTITION BY slice, channel ORDER BY ts, event_id) AS k FROM a) WHERE k <= 4""")
def stream_capped_alerts(spark: SparkSession, d: str) -> DataFrame:
    """At most four alerts per channel and micro-batch."""
    base = f"{shared_dir(spark)}/capped-{uuid.uuid4().hex}"
    alerts = _events(spark, d).filter("event_id <> -1").select(F.col("event_type").alias("channel"), "event_id", "ts")
    q = (alerts.writeStream.foreachBatch(S.batch_cap(base + "/out", 4, ("ts", "event_id")))
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    delete_path(spark, base + "/checkpoint")
    return spark.read.parquet(base + "/out").select("channel", "event_id")


@query("""WITH a AS (SELECT event_id AS id, event_type AS symbol, ts AS created_at FROM events WHERE event_id % 10 = 0),
 d AS (SELECT id, symbol, w AS "window", created_at + to_minutes(m) AS due FROM a CROSS JOIN (VALUES ('15m', 15), ('1h', 60), ('4h', 240)) v(w, m)),
 b AS (SELECT event_type AS symbol, ts, value, event_id FROM events WHERE event_id % 10 <> 0)
 SELECT d.id, d."window", min(b.ts) AS bar_ts, arg_min(b.value, (b.ts, b.event_id)) AS close FROM d LEFT JOIN b ON b.symbol = d.symbol AND b.ts >= d.due AND b.ts <= d.due + INTERVAL 10 MINUTE GROUP BY 1, 2""")
def stream_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """First price in the ten minutes from each due time on, or none; every tenth event is an assessment, the others are prices."""
    e = _events(spark, d)
    a = e.filter("event_id % 10 = 0 OR event_id = -1").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("ts").alias("created_at"))
    p = e.filter("event_id % 10 <> 0").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"), F.col("event_id").alias("tie"))
    return _drain(spark, S.stream_outcome_windows(a, p, tie="tie")).filter("id <> -1").select("id", "window", "bar_ts", "close")


@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT user_id % 300 AS event_id, ts, event_id AS tie, row_number() OVER (PARTITION BY user_id % 300 ORDER BY ts, event_id) AS k, (event_id % 5)::INT AS sources, (event_id % 100)::DOUBLE AS peak,
  (event_id // 7 % 20 / 2.0) AS silent, CASE WHEN event_id % 3 = 0 THEN event_id % 9 / 20.0 - 0.2 END AS spx, event_id % 2 = 0 AS bear FROM events),
 f(event_id, k, state, bear) AS (SELECT DISTINCT event_id, 0::BIGINT, 'NONE', false FROM v UNION ALL
 SELECT v.event_id, v.k, CASE WHEN f.state = 'NONE' THEN CASE WHEN v.sources >= 3 AND v.peak >= 70 THEN 'ALERTED' ELSE 'NONE' END
   WHEN f.state = 'CLOSED' THEN 'CLOSED' WHEN v.silent >= 6 THEN 'CLOSED' WHEN f.state <> 'ALERTED' THEN f.state
   WHEN v.spx IS NOT NULL AND (CASE WHEN f.bear THEN v.spx <= -0.2 ELSE v.spx >= 0.2 END) THEN 'CONFIRMED' ELSE f.state END,
  CASE WHEN f.state = 'NONE' AND v.sources >= 3 AND v.peak >= 70 THEN v.bear ELSE f.bear END FROM f JOIN v ON v.event_id = f.event_id AND v.k = f.k + 1)
 SELECT c.event_id, v.tie, c.state, CASE c.state WHEN 'ALERTED' THEN 'important' WHEN 'CONFIRMED' THEN 'critical' ELSE 'normal' END AS alert_level
 FROM f c JOIN f p ON p.event_id = c.event_id AND p.k = c.k - 1 JOIN v ON v.event_id = c.event_id AND v.k = c.k WHERE c.state <> p.state""")
def stream_escalations(spark: SparkSession, d: str) -> DataFrame:
    """State changes of 300 events over their sweeps."""
    i = F.col("event_id")
    e = _events(spark, d).select((F.col("user_id") % 300).alias("event_id"), F.col("ts").alias("swept_at"), i.alias("tie"), (i % 5).cast("int").alias("source_count"),
                                 (i % 100).cast("double").alias("peak_impact"), F.lit("corporate").alias("category"), F.when(i % 2 == 0, "BEARISH").otherwise("BULLISH").alias("sentiment"),
                                 (F.floor(i / 7) % 20 / 2.0).alias("silent_hours"), F.when(i % 3 == 0, i % 9 / 20.0 - 0.2).alias("spx_pct"),
                                 F.lit(None).cast("double").alias("vix_pct"), F.lit(None).cast("double").alias("brent_pct"))
    return _drain(spark, S.stream_escalation(e, tie="tie")).select("event_id", "tie", "state", "alert_level")
