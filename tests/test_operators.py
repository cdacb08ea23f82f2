"""Golden sequences, order properties and brute-force checks of the table operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators import decisions as X
from newsflow.operators import dedup as D
from newsflow.operators import flow as L
from newsflow.operators import folds as O
from newsflow.operators import similarity as S
from newsflow.operators.aggregates import ema_bias
from newsflow.operators.cluster import cluster_events
from newsflow.sinks import tables as K
from newsflow.sources import feeds, flows

T0 = datetime(2024, 1, 1)
NEWS = "news_id long, title string, snippet string, url string, source string, captured_at timestamp"


def news(spark, rows):
    return spark.createDataFrame([(i, t, s, u, "s", T0 + timedelta(minutes=i)) for i, t, s, u in rows], NEWS)


def ids(df, col="news_id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_greedy_is_not_transitive(spark):
    """A dropped row must not block a later one, on any tier."""
    n = news(spark, [(1, "alpha one", "x", "u1"), (2, "BREAKING: alpha one", "x", "u2"), (3, "gamma three", "z", "u2")])
    assert ids(D.dedup_batch(n, macro=F.lit(False))) == [1, 3]


def brute_near(rows, threshold):
    kept = []
    for i, t in rows:
        w = set(t.split())
        if not any(w and k and len(w & k) / len(w | k) >= threshold for _, k in kept):
            kept.append((i, w))
    return sorted(i for i, _ in kept)


@pytest.mark.parametrize("threshold", [0.45, 0.65])
def test_near_dedup_equals_brute_force_with_hot_group(spark, threshold):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(240):  # a third of the rows share one title
        t = "hot title words here" if i % 3 == 0 else " ".join(rng.sample(vocab, rng.randint(1, 7)))
        rows.append((i, t))
    n = news(spark, [(i, t, "", f"u{i}") for i, t in rows])
    want = brute_near(rows, threshold)
    assert ids(D.dedup_near(n, threshold)) == want
    again = D.dedup_near(n.repartition(7), threshold)
    assert ids(again) == want
    assert ids(D.dedup_near(again, threshold)) == want


def test_token_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    sets = {i: sorted(rng.sample("abcdefghij", rng.randint(1, 6))) for i in range(150)}
    sets = {i: s for j, (i, s) in enumerate(sets.items()) if s not in list(sets.values())[:j]}
    df = spark.createDataFrame(list(sets.items()), "k long, t array<string>")
    for threshold in (0.3, 0.5, 0.8):
        got = {(r["a"], r["b"]) for r in S.token_set_pairs(df, "k", "t", threshold).collect()}
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= threshold}
        assert got == want


def test_cosine_matches_equal_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    base = rng.normal(size=(5, 8))
    vecs = [(i, (base[i % 5] + 0.4 * rng.normal(size=8)).tolist()) for i in range(120)]
    df = spark.createDataFrame(vecs, "id long, embedding array<double>")
    got = {(r["query_id"], r["match_id"]) for r in S.cosine_matches(df, df, 0.82, pivots=6).collect()}
    m = np.array([v for _, v in vecs])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(120) if i != j and m[i] @ m[j] >= 0.82}
    assert got == want and want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in S.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[99] == got[100] == got[101] == 99


def test_cluster_window(spark):
    n = news(spark, [(1, "fed cuts rates today", "", "a"), (20, "fed cuts rates now today", "", "b"), (90, "fed cuts rates today", "", "c"), (91, "", "", "d")])
    got = {r["news_id"]: r["event_id"] for r in cluster_events(n).collect()}
    assert got == {1: 1, 20: 1, 90: None, 91: None}


FLOW = "ticker string, date date, main_net double, super_net double, big_net double, mid_net double, small_net double, main_pct double, close double, change_pct double"


def flow_rows(spark, supers, pcts, small=1e7, main_pct=18.0):
    rows = [("T", (T0 + timedelta(days=i)).date(), s, s, 0.0, 0.0, small, main_pct if i == len(supers) - 1 else 1.0, 0.0, p)
            for i, (s, p) in enumerate(zip(supers, pcts))]
    return spark.createDataFrame(rows, FLOW)


def test_divergence_golden(spark):
    r = L.flow_push_tier(L.divergence_signal(flow_rows(spark, [1.0e8, 0.5e8, 0.2e8], [1.0, 3.0, 4.85]))).first()
    assert (r["signal"], r["strength"], r["final_strength"]) == ("bearish_divergence", 85, "STRONG")
    assert (r["participation"], r["continuity"], r["push_tier"]) == ("extreme", "continuous_inflow", 2)
    out = L.flow_participation(flow_rows(spark, [-1e8, -2e8, -3e8], [0.0, 0.0, 0.0], main_pct=-20.0)).first()
    assert (out["continuity"], out["participation"]) == ("continuous_outflow", "extreme")
    assert L.divergence_signal(flow_rows(spark, [1.0], [1.0])).isEmpty()


def test_suppression_sequence(spark):
    def alert(i, minutes, key, intensity, tokens, tags=()):
        return ("me", i, T0 + timedelta(minutes=minutes), key, intensity, list(tokens), list(tags))
    rows = [alert(1, 0, "macro:inflation:up", 3, ["cpi", "hot"]), alert(2, 60, "macro:inflation:up", 3, ["cpi", "hot"]),
            alert(3, 120, "macro:inflation:up", 4, ["cpi", "hot"]), alert(4, 130, "ticker:A:up", 3, ["apple"], ["STRATEGIC_X"]),
            alert(5, 140, "ticker:B:up", 3, ["pear"], ["STRATEGIC_X"]), alert(6, 150, "ticker:C:up", 3, ["cpi", "hot", "x"]),
            alert(7, 120 + 24 * 60, "macro:inflation:up", 1, ["cpi", "hot"])]
    df = spark.createDataFrame(rows, "recipient string, id long, ts timestamp, dedup_key string, intensity int, tokens array<string>, strategic_tags array<string>")
    got = {r["id"]: r["passed"] for r in O.suppress_topics(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True}


def ema_by_hand(errors):
    bias = errors[0]
    for x in errors[1:]:
        raw = 7 * bias + 3 * x
        bias = (raw + 5) // 10 if raw >= 0 else -((5 - raw) // 10)
    return bias / 100


@pytest.mark.parametrize("errors", [
    [random.Random(5).randint(-10000, 10000) for _ in range(900)], [7], [7, -7],
    [(-1) ** k * 9999 for k in range(400)], [10 ** 6 if k % 97 else -10 ** 6 for k in range(1500)]])
def test_ema_bias_equals_a_plain_fold(spark, errors):
    a = spark.createDataFrame([(i, "monetary", e / 100) for i, e in enumerate(errors)] + [(10 ** 6, None, 1.0)], "id long, category string, impact_score double")
    o = spark.createDataFrame([(i, "1h", 0.0, T0 + timedelta(minutes=i)) for i in range(len(errors))] + [(10 ** 6, "1h", 0.0, T0), (0, "4h", -1.0, T0)],
                              "assessment_id long, window string, actual_score double, collected_at timestamp")
    got = {r["category"]: (r["bias"], r["samples"]) for r in ema_bias(a, o).collect()}
    assert got == {"monetary": (ema_by_hand(errors), len(errors)), None: (1.0, 1)}


def test_ema_bias_of_one_constant_error(spark):
    n = 100_000  # the bracket of two starts would never close
    a = spark.range(n).select("id", F.lit("monetary").alias("category"), F.lit(0.03).alias("impact_score"))
    o = spark.range(n).select(F.col("id").alias("assessment_id"), F.lit("1h").alias("window"), F.lit(0.0).alias("actual_score"),
                              F.timestamp_seconds("id").alias("collected_at"))
    assert ema_bias(a, o).collect() == [("monetary", 0.03, n)]


def test_stale_downgrade_and_health(spark):
    df = spark.createDataFrame([("important", 60.0, False), ("important", 60.5, False), ("critical", 99.0, False), ("important", 99.0, True), ("important", None, False)],
                               "l string, a double, m boolean")
    got = [r[0] for r in df.select(X.downgrade_if_stale(F.col("l"), F.col("a"), F.col("m"))).collect()]
    assert got == ["important", "notable", "critical", "important", "important"]
    h = spark.createDataFrame([(0, 3, 1.0, 0, 100.0, []), (1, 3, 1.0, 0, 100.0, []), (10, 3, 1.0, 2, 100.0, []), (10, 3, 5.0, 0, 100.0, []), (10, 3, 1.0, 6, 40.0, []), (10, 3, 1.0, 1, 100.0, ["rss"])],
                              "ingest_1h int, ingest_floor int, hours_since_push double, assessments_1h int, success_rate double, stalled array<string>")
    assert [r["state"] for r in X.health_verdict(h).collect()] == ["stalled", "quiet_ok", "healthy", "degraded", "degraded", "degraded"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "news")
    a = news(spark, [(1, "a", "", "u1"), (2, "b", "", "u1"), (3, "c", "", "u2")])
    assert ids(K.append_new(a, path, "url", ["news_id"])) == [1, 3]
    assert ids(K.append_new(news(spark, [(4, "d", "", "u2"), (5, "e", "", "u3")]), path, "url", ["news_id"])) == [5]
    flow = str(tmp_path / "flow")
    K.upsert_latest(spark.createDataFrame([("aapl", 1, 1.0)], "ticker string, day int, v double"), flow, ["ticker", "day"], upper="ticker")
    K.upsert_latest(spark.createDataFrame([("AAPL", 1, 2.0), ("AAPL", 2, 3.0)], "ticker string, day int, v double"), flow, ["ticker", "day"])
    assert sorted(tuple(r) for r in K.read_table(spark, flow).collect()) == [("AAPL", 1, 2.0), ("AAPL", 2, 3.0)]
    K.write_alerts(spark.createDataFrame([(1, "critical"), (2, "normal"), (3, "notable")], "id long, alert_level string"), str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 3


def test_file_sources(spark, tmp_path):
    rss = tmp_path / "feed.xml"
    items = "".join(f"<item><title>T{i}</title><link>http://x/{i}</link><description>&lt;b&gt;body {i}&lt;/b&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:0{i % 10} GMT</pubDate></item>" for i in range(25))
    rss.write_text(f"<?xml version='1.0'?><rss><channel>{items}<item><title></title><link>http://x/n</link></item></channel></rss>")
    got = feeds.read_rss(spark, str(rss), "src", F.lit("2024-02-01").cast("timestamp")).collect()
    assert len(got) == 25 and len(feeds.read_rss(spark, str(rss), "src", F.lit("2024-02-01").cast("timestamp"), limit=20).collect()) == 20
    assert got[0]["snippet"] == "body 0" and got[0]["published_at"] == datetime(2024, 1, 1, 10)
    atom = tmp_path / "atom.xml"
    atom.write_text('<?xml version="1.0"?><feed><entry><title>8-K - NVDA CORP</title><link href="http://sec/1"/><updated>2024</updated></entry><entry><title>8-K - OTHER</title><link href="http://sec/2"/></entry></feed>')
    filed = feeds.read_filings_xml(spark, str(atom), ["NVDA"]).collect()
    assert [(r["url"], r["tickers"]) for r in filed] == [("http://sec/1", ["NVDA"])]
    cases = tmp_path / "cases.jsonl"
    cases.write_text('{"case_id": "a", "title": "x", "intensity": 4, "is_push": true}\n{"case_id": "b", "title": "y"}\n')
    leaked = spark.createDataFrame([("b",)], "case_id string")
    assert [r["case_id"] for r in flows.read_cases(spark, str(cases), leaked).collect()] == ["a"]


def stored(spark, path):
    return sorted(tuple(r) for r in K.read_table(spark, path).collect())


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


def test_table_survives_a_job_that_dies(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert_latest(kv(spark, ("A", 1)), path, ["k"])
    K.upsert_latest(kv(spark, ("B", 2)), path, ["k"])
    # dies while or after writing its set, or after writing the version beside: nothing of it is read
    K._write_set(kv(spark, ("X", 9)), path, ["k"], K.BUCKETS, [])
    (tmp_path / "t" / "_versions" / ".half").mkdir()
    (tmp_path / "t" / "_versions" / ".half" / "half.json").write_text("{")
    assert stored(spark, path) == [("A", 1), ("B", 2)]
    K.upsert_latest(kv(spark, ("C", 3), ("A", 4)), path, ["k"])
    assert stored(spark, path) == [("A", 4), ("B", 2), ("C", 3)] and K.table_version(spark, path) == 3
    # dies before old versions are deleted: the newest one counts
    K._publish(spark, path, 4, K._version(spark, path, 3))
    assert stored(spark, path) == [("A", 4), ("B", 2), ("C", 3)]


def test_appends_and_upserts_see_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    K.append_new(kv(spark, ("a", 1), ("b", 2)), path, "k", ["v"])
    K.upsert_latest(kv(spark, ("b", 3)), path, ["k"])
    assert ids_of(K.append_new(kv(spark, ("b", 7), ("c", 3)), path, "k", ["v"])) == ["c"]
    assert ids_of(K.append_new(kv(spark, ("c", 8)), path, "k", ["v"])) == []
    K.append_log(kv(spark, ("c", 4), ("d", 5)), path)
    assert stored(spark, path) == [("a", 1), ("b", 3), ("c", 3), ("c", 4), ("d", 5)]
    K.replace_table(kv(spark, ("a", 1)), path, keys=["k"])
    assert ids_of(K.append_new(kv(spark, ("b", 7)), path, "k", ["v"])) == ["b"]  # dropped keys are new again
    plain = str(tmp_path / "plain")
    kv(spark, ("a", 1), ("b", 2)).write.parquet(plain)
    assert ids_of(K.append_new(kv(spark, ("b", 7), ("c", 3)), plain, "k", ["v"])) == ["c"]
    assert stored(spark, plain) == [("a", 1), ("b", 2), ("c", 3)]


def ids_of(df):
    return sorted(r["k"] for r in df.collect())


def test_upsert_leaves_untouched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert_latest(kv(spark, *[(f"k{i}", i) for i in range(200)]), path, ["k"])
    before = K._version(spark, path, 1)["sets"]
    K.upsert_latest(kv(spark, ("k7", 70)), path, ["k"])
    after = K._version(spark, path, 2)["sets"]
    assert len(before) == K.BUCKETS and sum(before[b] != after[b] for b in before) == 1
    assert len(stored(spark, path)) == 200 and ("k7", 70) in stored(spark, path)


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    K.upsert_latest(kv(spark, ("a", 1)), path, ["k"])
    publish, lost = K._publish, []

    def overtaken(spark_, path_, n, content):
        if not lost:  # another writer is faster between the write and the publication
            lost.append(n)
            monkeypatch.setattr(K, "_publish", publish)
            K.upsert_latest(kv(spark, ("a", 5), ("b", 6)), path, ["k"])
            monkeypatch.setattr(K, "_publish", overtaken)
        publish(spark_, path_, n, content)

    monkeypatch.setattr(K, "_publish", overtaken)
    assert ids_of(K.append_new(kv(spark, ("b", 2), ("c", 3)), path, "k", ["v"])) == ["c"]
    assert stored(spark, path) == [("a", 5), ("b", 6), ("c", 3)] and lost == [2] and K.table_version(spark, path) == 3
    with pytest.raises(K.LostRace):
        publish(spark, path, 3, K._version(spark, path, 2))
    assert stored(spark, path) == [("a", 5), ("b", 6), ("c", 3)]


def test_rows_without_key_and_repeated_patches(spark, tmp_path):
    path = str(tmp_path / "n")
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "i int, url string")
    assert sorted(r["i"] for r in K.append_new(rows, path, "url", ["i"]).collect()) == [1, 2, 3]
    assert sorted(r["i"] for r in D.dedup_url(rows, order=("i",)).collect()) == [1, 2, 3]
    mixed = spark.createDataFrame([("a", 1, 9, "x"), ("a", 2, 3, None)], "url string, at int, i int, w string")
    base = spark.createDataFrame([("a", 0, "old")], "url string, i int, w string")
    assert K.update_fields(base, mixed, "url", "at").collect() == [("a", 3, "old")]  # the newest patch row, not the largest values
    patch = spark.createDataFrame([("a", 5), ("a", 7)], "url string, i int")
    assert sorted((r["url"] or "", r["i"]) for r in K.update_fields(rows, patch, "url").collect()) == [("", 2), ("", 3), ("a", 7), ("a", 7)]


def test_feed_times_in_zones(spark):
    texts = ["Mon, 01 Jan 2024 10:00:00 GMT", "Mon, 01 Jan 2024 05:00:00 -0500", "1 Jan 2024 05:00 EST", "2024-01-01T10:00:00Z", "no time"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(feeds.parse_time(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 1, 10)] * 4 + [None]


def test_small_and_joined_dictionaries_agree(spark):
    from newsflow.operators.tagging import contains_join
    docs = spark.createDataFrame([(1, "The Cat sat"), (2, None), (3, "dog")], "news_id int, text string")
    words = spark.createDataFrame([("cat", 1), ("", 2), (None, 3), ("DO", 4), ("a", 5)], "keyword string, tag int")
    ways = [sorted((r["news_id"], r["tag"]) for r in contains_join(docs, words, inline_limit=n).collect()) for n in (2000, 0)]
    assert ways[0] == ways[1] == [(1, 1), (1, 5), (3, 4)]


def test_keywords_of_several_words_are_joined_on_words(spark):
    """No text is cut into runs of characters for keywords that have a word between two spaces; rows are as inlined."""
    from newsflow.operators.tagging import contains_join
    docs = spark.createDataFrame([(1, "x the Cat sat down"), (2, "the  cat sat"), (3, "bathe cat satin"), (4, "the\ncat sat"), (5, None), (6, "ab  cd")], "news_id int, text string")
    words = spark.createDataFrame([("the CAT sat", 1), ("he cat sat", 2), ("THE  cat sat", 3), (" cat ", 4), ("cat sat d", 5)], "keyword string, tag int")
    other = spark.createDataFrame([("b  c", 6), ("at", 7), ("e c", 8), (" ", 9)], "keyword string, tag int")
    rows = lambda df: sorted((r["news_id"], r["tag"]) for r in df.collect())
    joined = contains_join(docs, words, inline_limit=0)
    assert "regexp_extract_all(lower(coalesce(text" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(joined) == rows(contains_join(docs, words)) and len(rows(joined)) == 9
    every = words.unionByName(other)
    assert rows(contains_join(docs, every, inline_limit=0)) == rows(contains_join(docs, every))


def test_regions_outside_the_us(spark):
    from newsflow.functions.predicates import geo_tier_weight
    titles = ["Thailand baht slides as Bangkok flood costs rise", "Malaysia ringgit drops", "Istanbul index falls as lira weakens", "Real estate prices rise",
              "Warsaw stocks gain", "Naira weakens", "Hanoi exports grow"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(geo_tier_weight(F.col("t"), F.lit(False))).collect()]
    assert got == [0.25] * 7  # "Real" is listed as a currency and matches any use of the word
    import re
    from newsflow.functions import dictionaries
    names = [re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", p.replace(r"\b", "").replace(r"\s+", " ").replace(r"\s*", " ").replace("'?s?", "'s").replace("-?", "-").replace("s?", "s")).strip()
             for p in dictionaries.NON_US_PATTERNS]
    weights = spark.createDataFrame([(f"{n} headline",) for n in names], "t string").select("t", geo_tier_weight(F.col("t"), F.lit(False)).alias("w")).collect()
    assert [r["t"] for r in weights if r["w"] != 0.25] == []


def test_greedy_events_equal_the_live_rule(spark):
    """Random titles over few words against the step that the stream uses, article by article."""
    from newsflow.operators.cluster import cluster_events_greedy
    from newsflow.streaming.operators import cluster_step
    rng = random.Random(11)
    words = ["fed", "cuts", "rates", "oil", "jumps", "apple", "opens", "store", "bank", "falls"]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(1, 5))), T0 + timedelta(minutes=m)) for i, m in enumerate(sorted(rng.randrange(0, 900) for _ in range(250)))]
    recent, want = [], {}
    for i, title, at in rows:
        now = at.timestamp()
        live = [e for e in recent if now - e[1] <= 1800]
        event, seed = cluster_step(live, 0, set(title.split()), now, 1800, 0.45)
        recent = [[i, now, sorted(set(title.split())), event], *live]
        want[i] = event
        if seed is not None:
            want[seed] = event
    df = spark.createDataFrame(rows, "news_id long, title string, captured_at timestamp")
    assert {r["news_id"]: r["event_id"] for r in cluster_events_greedy(df).collect()} == want
    assert len(set(want.values())) > 5 and None in want.values()


def test_debounce_in_chunks_equals_the_plain_fold(spark):
    rng = random.Random(11)
    rows = [("hot", T0 + timedelta(seconds=rng.randrange(40_000)), i, rng.random() < 0.7) for i in range(1500)]
    rows += [(f"p{i % 3}", T0 + timedelta(minutes=i), 2000 + i, i % 4 != 0) for i in range(60)] + [("all", T0 + timedelta(minutes=i), 3000 + i, True) for i in range(200)]
    rows += [(None, T0 + timedelta(minutes=i), 4000 + i, True) for i in range(5)] + [("same", T0, 5000 + i, None if i == 2 else True) for i in range(6)]
    df = spark.createDataFrame(rows, "pipeline string, ts timestamp, tie long, should_alert boolean").repartition(4)
    for n, cooldown in [(2, 3600), (1, 0), (3, 100), (5, 10_000)]:
        want, states = set(), {}
        for key, at, tie, bad in sorted(rows, key=lambda r: (r[1], r[2])):
            if O.debounce_step(states.setdefault(key, {}), bool(bad), at.timestamp(), n, cooldown):
                want.add(tie)
        for size in (7, 50_000):
            got = O.debounce_alerts(df, n=n, cooldown_seconds=cooldown, tie="tie", chunk_rows=size).collect()
            assert len(got) == len(rows) and {r["tie"] for r in got if r["alerted"]} == want, (n, cooldown, size)


def test_keywords_that_begin_alike_meet_few_texts(spark):
    from newsflow.operators.tagging import contains_join
    docs = spark.createDataFrame([(i, f"the common text of the day with theword{i:04d}x") for i in range(300)] + [(999, None)], "news_id int, text string")
    words = spark.createDataFrame([(f"theword{i:04d}x", i) for i in range(5000)] + [("THE", -1), ("th", -2), ("zq", -3)], "keyword string, tag int")
    got = sorted((r["news_id"], r["tag"]) for r in contains_join(docs, words, inline_limit=2000).collect())
    assert got == sorted([(i, t) for i in range(300) for t in (i, -1, -2)])


def test_asof_change_with_all_bars_on_one_day(spark):
    from newsflow.operators.joins import price_change_since
    bars = [("S", T0 + timedelta(seconds=10 * i), float(100 + i)) for i in range(500)] + [("Q", T0, 5.0)]
    marks = [(i, "S", T0 + timedelta(seconds=10 * i - 5)) for i in range(0, 500, 7)] + [(9000, "S", T0 + timedelta(days=1)), (9001, "Q", T0 - timedelta(days=2)), (9002, "none", T0)]
    got = {r["anchor_id"]: (r["base"], r["last"]) for r in price_change_since(
        spark.createDataFrame(bars, "symbol string, ts timestamp, close double"), spark.createDataFrame(marks, "anchor_id long, symbol string, anchor_ts timestamp")).collect()}
    assert got == {**{i: (100.0 + i, 599.0) for i in range(0, 500, 7)}, 9000: (100.0, 599.0), 9001: (5.0, 5.0)}


def test_set_join_in_small_homes_equals_brute_force(spark, monkeypatch):
    """Sets of frequent and of rare tokens in many homes, alone and within neighbouring blocks."""
    monkeypatch.setattr(S, "BLOCK_SETS", (1, 9))
    monkeypatch.setattr(S, "DENSE_SHARE", 0.05)
    monkeypatch.setattr(S, "CHUNK_CELLS", 20)
    rng = random.Random(5)
    sets = {i: (rng.sample([f"w{n}" for n in range(12)], rng.randint(1, 8)) + [f"r{rng.randrange(40)}"], rng.randrange(4)) for i in range(120)}
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in sets.items()] + [(500, [], 0), (501, None, 1)], "k long, t array<string>, blk int")
    for threshold, block in [(0.3, None), (0.45, "blk"), (0.65, None)]:
        want = {}
        for a, (x, i) in sets.items():
            for b, (y, j) in sets.items():
                sim = len(set(x) & set(y)) / len(set(x) | set(y))
                if a < b and sim >= threshold and (block is None or abs(i - j) <= 1):
                    want[a, b] = sim
        got = S.token_set_pairs(df, "k", "t", threshold, block).collect()
        assert want and len(got) == len(want) and {(r["a"], r["b"]): r["sim"] for r in got} == want


def test_greedy_events_find_their_pairs_once_and_by_number(spark, monkeypatch):
    """The final plan reads the stored pairs; the similarity join is not run again for the neighbours."""
    from newsflow.operators import cluster
    kinds = []
    found = cluster.token_set_pairs
    monkeypatch.setattr(cluster, "token_set_pairs", lambda sets, key, *a, **kw: kinds.append(sets.schema[key].dataType.simpleString()) or found(sets, key, *a, **kw))
    out = cluster.cluster_events_greedy(news(spark, [(1, "fed cuts rates today", None, None), (2, "fed cuts rates today now", None, None), (3, "apple opens store", None, None)]))
    assert kinds == ["bigint"] and "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()
    assert {r["news_id"]: r["event_id"] for r in out.collect()} == {1: 1, 2: 1, 3: None}


def test_resonance_equals_brute_force(spark, monkeypatch):
    from newsflow.operators import tagging
    monkeypatch.setattr(tagging, "RESONANCE_ROWS", 7)
    rng = random.Random(4)
    words = ["fed", "cuts", "rates", "oil", "jumps", "apple", "opens", "store"]
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 4))), " ".join(rng.sample(words, rng.randint(1, 8))), T0 + timedelta(seconds=rng.randrange(2000)))
            for i in range(150)] + [(500 + i, "oil jumps", "oil jumps", T0 + timedelta(seconds=300)) for i in range(40)] + [(900, None, "oil", T0 + timedelta(seconds=400)), (901, "oil", None, T0)]
    df = spark.createDataFrame(rows, "news_id long, title string, snippet string, captured_at timestamp")
    got = {r["news_id"]: r["similar_count"] for r in tagging.resonance(df, 5, 0.3, text="snippet").collect()}
    want = {i: sum(j != i and 0 <= (at - then).total_seconds() <= 300 and len(set((text or "").split()) & set((title or "").split())) > 0.3 * len(set((text or "").split()))
                   for j, title, _, then in rows) for i, _, text, at in rows}
    assert got == want and max(want.values()) > 40


def test_semantic_keep_first_in_rounds(spark, monkeypatch):
    """Many neighbours, copies and rows without a vector, settled a few rows at a time."""
    import numpy as np
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 8))
    vecs = [(i, (base[i % 6] + 0.5 * rng.normal(size=8)).tolist()) for i in range(200)]
    vecs += [(210 + i, vecs[i][1]) for i in range(20)] + [(240, None)]
    units = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in vecs if v is not None}
    kept = []
    for i, _ in sorted(vecs + [(300, None)]):
        if i not in units or not any(j in units and (units[i] @ units[j] >= 0.3 or (units[i] == units[j]).all()) for j in kept):
            kept.append(i)
    df = spark.createDataFrame(vecs, "id long, embedding array<double>")
    news = df.select("id").union(spark.createDataFrame([(300,)], "id long"))
    sizes = []
    plain = D.vector_pairs
    monkeypatch.setattr(D, "ROUND_ROWS", 20)
    monkeypatch.setattr(D, "vector_pairs", lambda v, *a: (sizes.append(v.count()), plain(v, *a))[1])
    assert sorted(r["id"] for r in D.dedup_semantic(news, df, 0.3, order=(), id_col="id").collect()) == kept
    assert len(sizes) > 1 and max(sizes) < 60  # never all vectors against each other
    best = {(r["query_id"], r["match_id"]) for r in S.similar_topk(df.filter("id < 200"), df.filter("id < 200"), 0.3, 3).collect()}
    assert best == {(i, j) for i in range(200) for j in sorted((j for j in range(200) if j != i and units[i] @ units[j] >= 0.3), key=lambda j: (-(units[i] @ units[j]), j))[:3]}


def test_history_match_of_few_and_many_events(spark):
    """Events carried to the texts give the rows of the joins and of brute force, events without words included."""
    from newsflow.operators.tagging import match_history
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["oil", "rates", "Fed", "chips", "gold", "war", "tax", "bank"]) + rng.choice(["", "", "s", "1"]) for _ in range(n))
    events = [(i, text(rng.randrange(1, 40)), [rng.choice(["oil", "fed", "zinc", ""]), rng.choice(["oil", "tax1", "nothing"])],
               rng.choice(["monetary", "corporate", "", None]), rng.choice(["CRITICAL", "HIGH", None])) for i in range(30)]
    events += [(30, "  ", ["oil"], "monetary", "CRITICAL"), (31, None, ["oil"], "monetary", "CRITICAL")]
    texts = [(i, text(rng.randrange(1, 60)), rng.choice(["monetary", "corporate", "", None])) for i in range(60)]
    texts += [(60, None, "monetary"), (61, "short", "monetary"), (62, "nothing of that kind", "monetary"), (63, "none of these words", "")]
    news = spark.createDataFrame(texts, "news_id int, text string, category string").repartition(3)
    history = spark.createDataFrame(events, "event_no long, text string, tags array<string>, category string, level string")
    want = []
    for i, t, c in texts:
        low = (t or "").lower()
        scores = [(-(30 * bool(c and c == hc) + 8 * sum(x in low for x in set(tags) if x) + 0.5 * len(set(low.split()) & set(e.lower().split()))
                     + 5 * (level == "CRITICAL")), no) for no, e, tags, hc, level in events if e is not None] if len(low.strip()) >= 10 else []
        want += [(i, no, -s, r + 1) for r, (s, no) in enumerate(sorted(x for x in scores if x[0] <= -10)[:3])]
    for limit in (100, 1):
        rows = match_history(news, history, inline_limit=limit).collect()
        assert sorted((r["news_id"], r["event_no"], r["score"], r["rank"]) for r in rows) == sorted(want), limit
    assert match_history(news, history.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.65, 1.0])
def test_similar_sets_by_rare_tokens(monkeypatch, threshold):
    """All pairs of the threshold, none twice, also when every set comes in a step of its own and bits are shared."""
    import numpy as np
    from newsflow.operators import similarity as S
    rng = np.random.default_rng(3)
    common = 1 / np.arange(1, 301)

    def sets(n):
        return [set(rng.choice(300, rng.integers(1, 40), replace=False, p=common / common.sum()).tolist()) for _ in range(n)]

    one, two = sets(120), sets(90)
    one += [s | {1} for s in one[:30]] + [s - {max(s)} or {5} for s in one[:30]]
    two += [set(s) for s in one[:20]]
    flat = lambda x: (np.array([len(s) for s in x]), np.array([t for s in x for t in sorted(s, reverse=True)]))
    for steps in (1 << 20, 16):
        monkeypatch.setattr(S, "HITS", steps)
        for a, b, alone in ((one, two, False), (one, one, True)):
            want = {(i, j): len(x & y) for i, x in enumerate(a) for j, y in enumerate(b) if len(x & y) / len(x | y) >= threshold and (not alone or i < j)}
            rows = [r for i, j, n in S.similar_sets(*flat(a), *flat(b), threshold, alone) for r in zip(i.tolist(), j.tolist(), n.tolist())]
            assert len({r[:2] for r in rows}) == len(rows)
            assert {(i, j): n for i, j, n in rows if n / (len(a[i]) + len(b[j]) - n) >= threshold} == want and want


def test_title_pairs_are_found_once(spark):
    """The links in both directions come from one run of the set join."""
    from newsflow.operators import dedup as D
    news = spark.createDataFrame([(i, f"alpha beta gamma {i % 3}") for i in range(6)], "news_id long, title string")
    both = D._both_ways(D.title_pairs(news, 0.5).selectExpr("'t' as kind", "a", "b"))
    assert both._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1
    rows = {(r["a"], r["b"]) for r in both.collect()}
    assert len(rows) == 6 and all((b, a) in rows for a, b in rows)


def test_best_match_against_brute_force(spark, monkeypatch):
    """Best matches in many small blocks, with copies, zero vectors and ids that are strings."""
    import numpy as np
    rng = np.random.default_rng(9)
    m = rng.standard_normal((60, 6))
    m[50:] = m[:10]
    m[3] = 0
    m[20, 2] = np.nan
    rows = [(f"k{i:02d}", x.tolist()) for i, x in enumerate(m)]
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    monkeypatch.setattr(S, "BLOCK_CELLS", 20)
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    got = {r["query_id"]: r["max_similarity"] for r in S.max_similarity(df, df, 0.2).collect()}
    scores = np.nan_to_num(scores, nan=-2)  # a vector that is no number matches nothing and hides nothing
    want = {f"k{i:02d}": s.max() for i, s in enumerate(scores) if s.max() >= 0.2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    first = {r["query_id"]: r["match_id"] for r in S.similar_topk(df, df, 0.2, 1).collect()}
    assert first["k00"] == "k50" and first["k50"] == "k00"


def test_vectors_are_sent_as_given(spark):
    """Blocks receive each vector in the type of its table; the unit vectors in doubles are made there."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id long, embedding array<float>")
    assert S._cells([[1.0, 0.0]], 1.0).returnType.simpleString() == "struct<home:int,cells:array<int>>"
    plan = S.cosine_matches(df, df, 0.2, best=1)._jdf.queryExecution().analyzed()
    sent = [f for f in plan.children().head().output().mkString(";").split(";")]
    assert any(f.startswith("qv#") for f in sent)
    assert "array<double>" not in plan.children().head().schema().simpleString()


def test_title_rules_of_signal_scores_run_once(spark):
    """The rules of the titles are worked out before the novelty reads them twice; a given rule changes no novelty."""
    from newsflow.operators import windows as W
    from newsflow.plans import QUERIES
    plan = QUERIES["signal_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategic" not in plan and "RLIKE" not in plan and "lower(" not in plan
    rows = [(i, t, i % 3 == 0, T0 + timedelta(minutes=i)) for i, t in enumerate(["a", "", "a", None, "shock crash plunge", "a", "b", "b"])]
    df = spark.createDataFrame(rows, "news_id long, text string, is_breaking boolean, captured_at timestamp")
    given = df.withColumn("novelty_rule", W.novelty_rule(F.col("text"), F.col("is_breaking")))
    one, two = ({r["news_id"]: r["novelty"] for r in W.novelty(x).collect()} for x in (df, given))
    assert one == two and len(one) == 8 and one[2] == 0.85 and one[5] == 0.1
