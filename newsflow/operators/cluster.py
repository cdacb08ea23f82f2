"""Events: groups of similar headlines close in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import event_title, title_tokens
from ..runtime import checkpoint
from .dedup import _token_key
from .folds import ordered_fold
from .similarity import connected_components, token_set_pairs

CLUSTER_WINDOW_SECONDS = 30 * 60
CLUSTER_THRESHOLD = 0.45


def cluster_events(news: DataFrame, window_seconds: int = CLUSTER_WINDOW_SECONDS,
                   threshold: float = CLUSTER_THRESHOLD, id_col: str = "news_id",
                   ts: str = "captured_at") -> DataFrame:
    """(id, event_id): articles linked by title similarity within the time window.

    Articles with one token set in one window-long bucket form a cell; linking works on cells.
    Two cells of a bucket are always within the window of each other, cells of neighbouring
    buckets exactly when the gap between their ends is. The event id is its smallest article id;
    articles without a partner get null.
    """
    seconds = F.unix_micros(F.col(ts)) / 1e6
    items = (news.withColumn("_t", title_tokens(F.coalesce("title", F.lit(""))))
             .withColumn("_k", _token_key(F.col("_t"))).withColumn("_s", seconds)
             .withColumn("_b", F.floor(seconds / window_seconds)))
    cells = (items.filter("_k is not null").groupBy("_k", "_b")
             .agg(F.first("_t").alias("tokens"), F.min("_s").alias("lo"), F.max("_s").alias("hi"),
                  F.min(id_col).alias("cell"), F.count("*").alias("n")))
    similar = token_set_pairs(cells, "cell", "tokens", threshold, block="_b").select("a", "b")
    nxt = cells.select("_k", (F.col("_b") - 1).alias("_b"), F.col("cell").alias("b"))
    same = cells.select("_k", "_b", F.col("cell").alias("a")).join(nxt, ["_k", "_b"]).select("a", "b")
    span = cells.select("cell", "_b", "lo", "hi")
    a, b = (span.select(F.col("cell").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("_b", "lo", "hi")])
            for s in ("a", "b"))
    gap = F.when(F.col("_b_a") < F.col("_b_b"), F.col("lo_b") - F.col("hi_a")).when(
        F.col("_b_a") > F.col("_b_b"), F.col("lo_a") - F.col("hi_b")).otherwise(F.lit(0.0))
    near = (similar.unionByName(same).distinct().join(a, "a").join(b, "b")
            .filter(gap <= window_seconds).select("a", "b"))
    groups = connected_components(near).withColumnRenamed("node", "cell")
    # a cell with two or more articles is an event by itself
    labelled = (cells.join(groups, "cell", "left")
                .withColumn("event_id", F.coalesce("component", F.when(F.col("n") > 1, F.col("cell"))))
                .select("_k", "_b", "event_id"))
    return items.join(labelled, ["_k", "_b"], "left").select(id_col, "event_id")


def greedy_step(cells: dict, row: dict, window: float) -> dict:
    """One article against the recent ones: join the event of the most similar article that has one,
    else pair with the most similar single one; the newest wins ties.

    ``cells`` maps a token set to its newest article with an event and its single article; copies of
    one title need no more than these two.
    """
    now, cells["seq"] = row["_s"], cells.get("seq", 0) + 1
    best_event = best_single = None
    for key, sim in zip(row["_others"], row["_sims"]):
        cell = cells.get(key)
        if cell is None:
            continue
        for kind in ("event", "single"):
            entry = cell.get(kind)
            if entry is not None and now - entry[0] <= window:
                rated = (sim, entry[1], key, entry)
                if kind == "event" and (best_event is None or rated[:2] > best_event[:2]):
                    best_event = rated
                if kind == "single" and (best_single is None or rated[:2] > best_single[:2]):
                    best_single = rated
    own = cells.setdefault(row["_k"], {})
    event = seed = None
    if best_event is not None:
        event = best_event[3][2]
    elif best_single is not None:
        _, _, key, entry = best_single
        event = seed = entry[2]
        cells[key]["single"] = None
        if cells[key].get("event") is None or cells[key]["event"][1] < entry[1]:
            cells[key]["event"] = entry
    own["single" if event is None else "event"] = (now, cells["seq"], row["_id"] if event is None else event)
    if cells["seq"] % 1000 == 0:  # forget what left the window
        for key in [k for k, c in cells.items() if k != "seq" and all(e is None or now - e[0] > window for e in c.values())]:
            del cells[key]
    return {"event_id": event, "_seed": seed}


def cluster_events_greedy(news: DataFrame, window_seconds: int = CLUSTER_WINDOW_SECONDS, threshold: float = CLUSTER_THRESHOLD,
                          id_col: str = "news_id", ts: str = "captured_at") -> DataFrame:
    """(id, event_id) by the live rule: each article joins the event of its best recent match, else pairs
    with its best single match; the event is named by its first article.

    Similar token sets are found once, under numbers instead of their long keys. Only articles whose token sets
    are linked, directly or over others, depend on each other: each such component is folded in time order, with
    two entries of state per token set of the window.
    """
    items = (news.select(F.col(id_col).alias("_id"), F.col(ts).alias("_ts"), title_tokens(F.coalesce("title", F.lit(""))).alias("_t"))
             .withColumn("_h", _token_key(F.col("_t"))).filter("_h is not null").withColumn("_s", F.unix_micros("_ts") / 1e6)
             .withColumn("_b", F.floor(F.col("_s") / window_seconds)))
    articles = checkpoint(items.select("_id", "_s", "_h"))
    keys = checkpoint(articles.select("_h").distinct().withColumn("_k", F.monotonically_increasing_id()))
    cells = items.groupBy("_h", "_b").agg(F.first("_t").alias("tokens")).join(keys, "_h").select("_k", "_b", "tokens")
    # a token set is a row of each bucket it is in; it meets itself in the next one
    pairs = checkpoint(token_set_pairs(cells, "_k", "tokens", threshold, block="_b").filter("a <> b").distinct())
    parts = connected_components(pairs.select("a", "b")).withColumnRenamed("node", "_k")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    near = both.groupBy(F.col("a").alias("_k")).agg(F.collect_list("b").alias("_o"), F.collect_list("sim").alias("_v"))
    rows = (articles.join(keys, "_h").drop("_h").join(near, "_k", "left").join(parts, "_k", "left")
            .select("_id", "_s", "_k", F.coalesce("component", "_k").alias("_part"),
                    F.concat(F.array("_k"), F.coalesce("_o", F.array().cast("array<bigint>"))).alias("_others"),
                    F.concat(F.array(F.lit(1.0)), F.coalesce("_v", F.array().cast("array<double>"))).alias("_sims")))
    kind = news.schema[id_col].dataType
    folded = ordered_fold(rows, ["_part"], ["_s", "_id"], dict, lambda cells, row: greedy_step(cells, row, window_seconds),
                          [("event_id", kind), ("_seed", kind)])
    made = folded.select(F.explode(F.array(F.struct(F.col("_id").alias("n"), F.col("event_id").alias("event_id")),
                                           F.struct(F.col("_seed").alias("n"), F.col("_seed").alias("event_id")))).alias("m"))
    assigned = made.select(F.col("m.n").alias(id_col), "m.event_id").filter("event_id is not null").distinct()
    return news.select(id_col).join(assigned, id_col, "left").select(id_col, "event_id")


def event_lines(news: DataFrame, assigned: DataFrame, id_col: str = "news_id",
                ts: str = "captured_at") -> DataFrame:
    """One row per event: title of the first article, sources, articles and times."""
    df = news.join(assigned.filter("event_id is not null"), id_col)
    return df.groupBy("event_id").agg(
        event_title(F.min_by("title", F.struct(ts, id_col))).alias("title"),
        F.count("*").alias("article_count"), F.count_distinct("source").alias("source_count"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_updated"))


def event_members(events: DataFrame, news: DataFrame, id_col: str = "news_id") -> DataFrame:
    """Rows of the articles listed in ``member_ids``."""
    return (events.select("event_id", F.explode("member_ids").alias(id_col))
            .join(news, id_col))


def event_momentum(members: DataFrame, assessments: DataFrame, events: DataFrame | None = None,
                   id_col: str = "news_id") -> DataFrame:
    """Distinct sources (at least the stored count) and the peak assessment per event."""
    sources = members.groupBy("event_id").agg(
        F.count_distinct(F.nullif("source", F.lit(""))).alias("source_count"))
    peak = (members.select("event_id", id_col).join(assessments, id_col)
            .groupBy("event_id").agg(
                F.max("impact_score").alias("peak_impact"),
                F.max_by("category", F.struct("impact_score", -F.col("id"))).alias("category"),
                F.max_by("sentiment", F.struct("impact_score", -F.col("id"))).alias("sentiment")))
    out = sources.join(peak, "event_id", "left").withColumn(
        "peak_impact", F.coalesce("peak_impact", F.lit(0.0)))
    if events is None:
        return out
    stored = events.select("event_id", F.col("source_count").alias("_stored"))
    return (out.join(stored, "event_id", "left")
            .withColumn("source_count", F.greatest("source_count", F.coalesce("_stored", F.lit(0)))).drop("_stored"))


def news_event_age(news: DataFrame, events: DataFrame, as_of, id_col: str = "news_id") -> DataFrame:
    """Source count and age in minutes of each article's active event; null without one."""
    active = events.filter("is_active").select("event_id", "source_count", "first_seen")
    minutes = (F.unix_micros(as_of) - F.unix_micros("first_seen")) / 6e7
    return (news.select(id_col, "event_id").join(active, "event_id", "left")
            .select(id_col, F.coalesce("source_count", F.lit(0)).alias("source_count"),
                    F.when(minutes.isNotNull(), F.greatest(minutes, F.lit(0.0))).alias("age_minutes")))
