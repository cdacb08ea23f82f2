"""The composed jobs end to end on small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsflow.operators import dedup as D
from newsflow.plans import jobs

T0 = datetime(2024, 1, 2, 15)


def test_ingest_screen_decide_dispatch(spark, tmp_path):
    rows = [(1, "Jensen Huang invests in Marvell", "s", "u1", "CNBC", T0), (2, "BREAKING: Jensen Huang invests in Marvell", "s", "u2", "Reuters", T0 + timedelta(minutes=1)),
            (3, "Pentagon awards Intel a contract", "s", "u3", "CNBC", T0 + timedelta(minutes=2)), (4, "Local bakery wins prize", "s", "u4", "Blog", T0 + timedelta(minutes=3))]
    news = spark.createDataFrame(rows, "news_id long, title string, snippet string, url string, source string, captured_at timestamp")
    path = str(tmp_path / "news")
    stored = jobs.ingest(news, path)
    assert sorted(r["news_id"] for r in stored.collect()) == [1, 3, 4]
    assert jobs.ingest(news, path, seen=spark.read.parquet(path)).filter("news_id <> 2").count() == 0
    screened = jobs.screen_batch(stored)
    assert sorted(r["news_id"] for r in screened.collect()) == [1, 3]
    verdicts = spark.createDataFrame([(1, True, [1], 5, "up", True, "immediate", "NVDA buys into Marvell", T0), (3, True, [1], 4, "up", True, "immediate", "Intel wins Pentagon deal", T0)],
                                     "news_id long, is_event boolean, event_types array<int>, intensity int, direction string, confirmed boolean, timeliness string, headline_signal string, published_at timestamp")
    extra = screened.withColumn("source_count", F.lit(1)).withColumn("age_minutes", F.lit(5.0))
    decided = jobs.decide(extra, verdicts)
    levels = {r["news_id"]: r["reviewed_level"] for r in decided.collect()}
    assert levels == {1: "critical", 3: "important"}
    people = spark.createDataFrame([("a", "pushover"), ("a-chat", "telegram")], "recipient string, channel string")
    sent = {(r["id"], r["channel"]) for r in jobs.dispatch(decided, people).collect()}
    assert sent == {(1, "pushover"), (3, "pushover"), (1, "telegram"), (3, "telegram")}


def test_semantic_history_uses_the_wider_scale(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "news_id long")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])], "news_id long, embedding array<double>")
    past = spark.createDataFrame([(9, [0.7, 0.714])], "news_id long, embedding array<double>")
    kept = D.dedup_semantic(items, vec, 0.82, order=())
    assert sorted(r["news_id"] for r in kept.collect()) == [1, 3]
    # cosine 0.7 to the stored article is a repeat on the history scale (0.64), not in the batch
    assert D.dedup_semantic(items, vec, 0.82, history=past, order=()).count() == 0
