"""Dictionary tagging: tickers, indicators, sectors, people.

Dictionaries of ordinary size become one literal inside the row expression: no join, no
shuffle. Larger ones go through a join on short character anchors instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import entities as E
from ..functions.lexicon import Found, Lexicon
from ..functions.text import string_array, word_set
from ..functions.vocabulary import entity_lists, lowered
from ..runtime import checkpoint, small_rows
from .ranking import merge_tags
from .similarity import CHUNK_CELLS, overlap_chunks, token_codes
from .windows import top_per_key

INLINE_LIMIT = 2000


def _strings(values) -> Column:
    return string_array(values).cast("array<string>")


def extract_tickers(text: Column, known=E.KNOWN_TICKERS, names=E.COMPANY_TICKERS,
                    names_cjk=E.COMPANY_TICKERS_CJK, watch=(), word_boundary: bool = False, found: Found | None = None) -> Column:
    """Sorted distinct tickers: $CODE, known bare codes, and company names.

    Names match as substrings, as in "arm" inside "farm"; ``word_boundary`` asks for whole words. ``found``
    answers for the lists "names" and "names_cjk" of a scan of the lower-case text.
    """
    listed = list(dict.fromkeys([*known, *watch]))
    rx = F.lit(r"(?<![A-Z])(\$?[A-Z]{1,5})(?![A-Z])")
    raw = F.regexp_extract_all(text, rx, F.lit(1))
    codes = F.transform(F.filter(raw, lambda t: t.startswith("$") | F.array_contains(_strings(listed), t)),
                        lambda t: F.regexp_replace(t, r"^\$", ""))
    low = F.lower(text)

    def by_name(haystack: Column, name: str, mapping: dict[str, str], whole: bool) -> Column:
        answers = found or Lexicon({name: list(mapping)}).found(haystack)
        rows = answers.pick(name, [{"n": n, "t": t if t in known else None} for n, t in mapping.items()])
        if whole:
            rows = F.filter(rows, lambda p: F.regexp_like(haystack, F.concat(F.lit(r"\b"), p["n"], F.lit(r"\b"))))
        return F.array_compact(F.transform(rows, lambda p: p["t"]))

    every = F.concat(codes, by_name(low, "names", names, word_boundary), by_name(text, "names_cjk", names_cjk, False))
    return F.array_sort(F.array_distinct(every))


def mentioned_tickers(text: Column, watch) -> Column:
    up = F.upper(text)
    return F.filter(_strings(watch), lambda t: F.contains(up, F.upper(t)))


def tag_words(text: Column, words, found: Found | None = None, name: str = "words") -> Column:
    """Distinct dictionary words contained in the text, without regard to case."""
    listed = list(dict.fromkeys(words))
    return (found or Lexicon({name: lowered(listed)}).found(F.lower(text))).words(name, listed)


def tag_groups(text: Column, groups: dict[str, list[str]], found: Found | None = None, name: str = "words") -> Column:
    """Names of the groups with a contained word, e.g. sectors."""
    pairs = [(g, w.lower()) for g, words in groups.items() for w in words]
    answers = found or Lexicon({name: [w for _, w in pairs]}).found(F.lower(text))
    return F.array_distinct(answers.pick(name, [g for g, _ in pairs]))


def people_tier(text: Column, people: dict[str, int] = E.PEOPLE_TIERS, found: Found | None = None) -> Column:
    """Struct(found, tier): best tier of any named person, (false, 1) when nobody is named."""
    answers = found or Lexicon({"people": lowered(people)}).found(F.lower(text))
    best = F.array_min(answers.pick("people", list(people.values())))
    return F.struct(best.isNotNull().alias("found"), F.coalesce(best, F.lit(1)).alias("tier"))


# --- dictionaries as tables --------------------------------------------------------------------
def contains_join(docs: DataFrame, dictionary: DataFrame, id_col: str = "news_id", text: str = "text",
                  inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """(id, <dictionary columns>) for every dictionary ``keyword`` contained in the text.

    Null and empty keywords match nothing. A dictionary of at most ``inline_limit`` rows is checked in
    size and inlined. A larger one is joined on anchors. A word of the keyword between two of its spaces is a
    word of each text that contains the keyword, so such words are its anchors; a keyword without one has its
    runs of three characters (or itself if shorter), and only then are texts cut into runs. Each keyword uses
    the anchor that the fewest texts have, by a count over the texts, so keywords that all begin with
    a common word do not meet every text. Only ids and anchors that the dictionary has are shuffled; the text is
    joined back once per candidate document, so ids must be unique. Both ways give the same rows.
    """
    dictionary = dictionary.filter(F.coalesce(F.col("keyword"), F.lit("")) != "")
    cols = dictionary.columns
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = small_rows(dictionary, inline_limit)
    if rows is not None:
        if not rows:
            return docs.select(id_col).limit(0).select(
                id_col, *[F.lit(None).cast(f.dataType).alias(f.name) for f in dictionary.schema.fields])
        kinds = {f.name: f.dataType for f in dictionary.schema.fields}
        table = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in cols]) for r in rows])
        places = Lexicon({"keyword": [r["keyword"].lower() for r in rows]}).found(low).places("keyword")
        return docs.select(id_col, F.explode(F.transform(places, lambda p: F.get(table, p))).alias("k")).select(id_col, "k.*")
    def runs_of(c: Column, n: int) -> Column:
        return F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))

    head = F.lower("keyword")
    inner = F.filter(F.split(head, " "), lambda w, i: (i > 0) & (i < F.size(F.split(head, " ")) - 1) & (w != ""))
    runs = F.when(F.length(head) < 3, F.array(head)).otherwise(runs_of(head, 3))
    grams = (dictionary.withColumn("_low", head).withColumn("_inner", inner).withColumn("_size", F.when(F.size("_inner") == 0, F.least(F.length("_low"), F.lit(3))).otherwise(0))
             .withColumn("_anchor", F.explode(F.array_distinct(F.when(F.size("_inner") > 0, F.col("_inner")).otherwise(runs)))))
    sizes = sorted(r[0] for r in grams.select("_size").distinct().collect())  # 0 for words, lengths of runs: at most four
    listed = grams.select((F.col("_size") == 0).alias("_word"), "_anchor").distinct()
    parts = [F.split(low, " ") if n == 0 else runs_of(low, n) for n in sizes] or [F.array().cast("array<string>")]
    pairs = None
    for n, part in zip(sizes or [0], parts):
        found = (docs.select(id_col, F.explode(F.array_distinct(part)).alias("_anchor")).withColumn("_word", F.lit(n == 0))
                 .join(listed, ["_word", "_anchor"], "left_semi"))
        pairs = found if pairs is None else pairs.unionByName(found)
    texts = pairs.groupBy("_word", "_anchor").agg(F.count("*").alias("_texts"))
    # a keyword with a run that no text has is in no text
    rarest = (grams.select("_low", (F.col("_size") == 0).alias("_word"), "_anchor").distinct().join(texts, ["_word", "_anchor"], "left")
              .groupBy("_low").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_anchor").alias("a"), F.col("_word").alias("w"))).alias("_r"))
              .filter("_r.n > 0").select("_low", F.col("_r.w").alias("_word"), F.col("_r.a").alias("_anchor")))
    keyed = dictionary.withColumn("_low", head).join(rarest, "_low").drop("_low")
    candidates = pairs.join(keyed, ["_word", "_anchor"]).groupBy(id_col).agg(F.collect_list(F.struct(*cols)).alias("_words"))
    hits = F.filter("_words", lambda k: F.contains(low, F.lower(k["keyword"])))
    return (docs.select(id_col, text).join(candidates, id_col).select(id_col, F.explode(hits).alias("k"))
            .select(id_col, "k.*"))


def tag_dictionary(docs: DataFrame, dictionary: DataFrame, id_col: str = "news_id", text: str = "text",
                   tag: str = "tag") -> DataFrame:
    """One row per text with the sorted set of tags whose keyword it contains."""
    hits = contains_join(docs, dictionary, id_col, text)
    return hits.groupBy(id_col).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


# --- reference joins ----------------------------------------------------------------------------
def ticker_to_etf(tickers: Column, tag_text: Column, category: Column, ticker_etfs=E.TICKER_ETFS,
                  event_etfs=E.EVENT_ETFS, broad=E.BROAD_CATEGORIES) -> Column:
    """Sorted distinct ETFs related to the tickers, the tags and the event category."""
    table = F.create_map(*[x for t, etfs in ticker_etfs.items() for x in (F.lit(t), _strings(etfs))])
    nothing = F.array().cast("array<string>")
    direct = F.flatten(F.transform(tickers, lambda t: F.coalesce(F.try_element_at(table, F.upper(t)), nothing)))
    up = F.upper(F.coalesce(tag_text, F.lit("")))
    low = F.lower(F.coalesce(category, F.lit("")))
    events = F.flatten(F.array(*[
        F.when(up.contains(k) | low.contains(k.lower()), _strings(etfs)).otherwise(nothing)
        for k, etfs in event_etfs.items()]))
    spy = F.when(low.isin(list(broad)), _strings(["SPY"])).otherwise(nothing)
    every = F.array_sort(F.array_distinct(F.concat(direct, events, spy)))
    return F.when(F.size(tickers) > 0, every).otherwise(nothing)


def codes_of(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and codes (places in ``known``) of token lists; other tokens are left out."""
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    codes = np.asarray(pc.index_in(lists.flatten(), value_set=known).fill_null(-1)).astype(np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)[codes >= 0]
    return np.bincount(rows, minlength=len(sizes)), codes[codes >= 0]


def match_listed(n: DataFrame, events: list, k: int, floor: float) -> DataFrame:
    """(nid, event, score): the best k of the listed events for each text, ``event`` being the place in the list.

    Each Arrow batch of texts counts shared words and tags with all events by matrices, so a text is read once, no pair
    becomes a row and nothing but the best k leaves a task. Equal scores go to the event listed first.
    """
    words = [e["hw"] or [] for e in events]
    tags = [[t.lower() for t in e["tags"] or [] if t] for e in events]
    known, listed = sorted({w for ws in words for w in ws}), sorted({t for ts in tags for t in ts})
    categories = sorted({e["hcat"] for e in events if e["hcat"]})
    place, number = {t: i for i, t in enumerate(listed)}, {c: i for i, c in enumerate(categories)}
    wanted = np.zeros((len(listed), len(events)), np.float32)
    for j, ts in enumerate(tags):
        for t in ts:
            wanted[place[t], j] += 8
    category = np.array([number.get(e["hcat"], -2) for e in events])
    critical = np.array([e["crit"] for e in events], np.float32)
    sizes, codes = codes_of(pa.array(words, pa.list_(pa.string())), pa.array(known, pa.string()))
    lexicon = Lexicon({"tag": listed})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_sizes, a_codes = codes_of(batch.column("nw"), pa.array(known, pa.string()))
            t_sizes, t_codes = (np.asarray(x).astype(np.int64) for x in (batch.column("tagged").value_lengths(), batch.column("tagged").flatten()))
            mine = np.asarray(pc.index_in(batch.column("ncat"), value_set=pa.array(categories, pa.string())).fill_null(-1))
            t_ends, found = np.cumsum(t_sizes), []
            step = max(1, CHUNK_CELLS // max(1, len(events), len(listed)))
            shares = overlap_chunks(a_sizes, a_codes, sizes, codes, step) if len(a_codes) else ((i, 0) for i in range(0, len(batch), step))
            for first, shared in shares:
                last = min(len(batch), first + step)
                there = np.zeros((last - first, len(listed)), np.float32)
                there[np.repeat(np.arange(last - first), t_sizes[first:last]), t_codes[t_ends[first] - t_sizes[first]:t_ends[last - 1]]] = 1
                score = there @ wanted + critical + np.float32(0.5) * shared + np.float32(30) * (mine[first:last, None] == category)
                every = np.arange(len(score))
                for _ in range(min(k, len(events))):
                    best = score.argmax(axis=1)
                    points = score[every, best].astype(np.float64)
                    score[every, best] = -np.inf
                    at = np.flatnonzero(points >= floor)
                    found.append((first + at, best[at], points[at]))
            if found:
                at, best, points = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column("nid").take(pa.array(at)), pa.array(best, pa.int32()), pa.array(points)], names=["nid", "event", "score"])

    read = n.select("nid", "nw", "ncat", lexicon.found(F.col("_low")).places("tag").alias("tagged"))
    return read.mapInArrow(run, f"nid {n.schema['nid'].dataType.simpleString()}, event int, score double")


def match_history(news: DataFrame, history: DataFrame, k: int = 3, id_col: str = "news_id",
                  text: str = "text", category: str | None = "category", floor: float = 10.0,
                  history_id: str = "event_no", inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """Top k labelled past events per text: 30 for the category, 8 a contained tag, 0.5 a shared word, 5 if critical.

    A history of at most ``inline_limit`` events is checked in size and carried to the texts (``match_listed``). A larger
    one meets them by a threshold algorithm. Each event's words are ordered rare first; its ``last`` most common words are no
    join keys. An event that shares none of its other words with a text shares at most ``last`` words, too
    few to reach the floor by words alone, so it can only enter through a tag or its category. Of a
    category, each text meets the best k events by what needs no text. Only texts whose k-th best score
    could still be passed by an unseen event of the category meet the common words, within the category.
    """
    critical = F.when(F.col("level") == "CRITICAL", 5).otherwise(0)
    last = max(0, math.ceil((floor - 5) / 0.5) - 1)
    n = news.filter(F.length(F.trim(F.lower(text))) >= 10).select(
        F.col(id_col).alias("nid"), F.lower(text).alias("_low"), word_set(F.col(text)).alias("nw"),
        F.coalesce(F.col(category) if category else F.lit(None).cast("string"), F.lit("")).alias("ncat"))
    h = history.select(F.col(history_id).alias("hid"), word_set(F.col("text")).alias("hw"),
                       F.array_distinct("tags").alias("tags"), F.col("category").alias("hcat"), critical.alias("crit")).filter("hw IS NOT NULL")
    events = small_rows(h, inline_limit)
    if events is not None:
        events.sort(key=lambda e: (e["hid"] is not None, e["hid"]))
        kind = h.schema["hid"].dataType
        numbers = F.array(*[F.lit(e["hid"]).cast(kind) for e in events]) if events else F.array().cast(f"array<{kind.simpleString()}>")
        best = top_per_key(match_listed(n, events, k, floor), ["nid"], [F.desc("score"), "event"], k, rank="rank")
        return best.select(F.col("nid").alias(id_col), F.get(numbers, "event").alias(history_id), "score", "rank")
    posted = h.select("hid", F.explode("hw").alias("w"))
    common = posted.groupBy("w").agg(F.count("*").alias("df"))
    by_event = (posted.join(common, "w").groupBy("hid")
                .agg(F.array_sort(F.collect_list(F.struct(F.col("df"), F.col("w")))).alias("ws"))
                .select("hid", F.transform("ws", lambda x: x["w"]).alias("ws"), F.greatest(F.size("ws") - last, F.lit(0)).alias("cut"))
                .select("hid", F.slice("ws", F.lit(1), F.col("cut")).alias("rare"), F.slice("ws", F.col("cut") + 1, F.lit(max(last, 1))).alias("often")))
    rare = by_event.select("hid", F.explode("rare").alias("w"))
    often = by_event.select("hid", F.explode("often").alias("w"))
    said = checkpoint(n.select("nid", F.explode("nw").alias("w")).join(common.select("w"), "w", "left_semi"))
    frequent = (said.join(often.select("w").distinct(), "w").groupBy("nid").agg(F.collect_list("w").alias("ws")))
    keys, zero = ["nid", "hid"], F.lit(0)
    words = said.join(rare, "w").groupBy(*keys).agg(F.count("*").alias("shared"))
    tags = (contains_join(n.withColumn("_t", F.col("_low")), h.select("hid", F.explode("tags").alias("keyword")), "nid", "_t", inline_limit)
            .groupBy(*keys).agg(F.count("*").alias("tagged")))
    per_category = top_per_key(h.select("hid", "hcat", "crit"), ["hcat"], [F.desc("crit"), "hid"], k).select("hid", "hcat")
    placed = checkpoint(n.filter("ncat <> ''").select("nid", "ncat"))
    best = placed.join(per_category, F.col("ncat") == F.col("hcat")).select(*keys)
    seen = (words.select(*keys, "shared", zero.alias("tagged"))
            .unionByName(tags.select(*keys, zero.alias("shared"), "tagged"))
            .unionByName(best.select(*keys, zero.alias("shared"), zero.alias("tagged")))
            .groupBy(*keys).agg(F.sum("shared").alias("shared"), F.sum("tagged").alias("tagged")))
    seen = checkpoint(seen)
    facts = h.select("hid", "hcat", "crit").join(by_event.select("hid", "often"), "hid", "left")  # an event of blanks has no words
    frequent = checkpoint(frequent)
    texts = frequent.join(placed, "nid", "full").select("nid", F.coalesce("ncat", F.lit("")).alias("ncat"), "ws")

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(facts, "hid").join(texts, "nid", "left").fillna({"ncat": ""})
        shared = F.col("shared") + F.coalesce(F.size(F.array_intersect("often", "ws")), zero)
        points = (F.when((F.col("ncat") != "") & (F.col("ncat") == F.col("hcat")), 30).otherwise(0)
                  + F.col("tagged") * 8 + shared * 0.5 + F.col("crit"))
        return both.select(*keys, points.alias("score")).filter(F.col("score") >= floor)

    def top(pairs: DataFrame) -> DataFrame:
        return top_per_key(pairs, ["nid"], [F.desc("score"), "hid"], k, rank="rank")

    first = checkpoint(top(scored(seen)))
    unseen = 30 + 5 + 0.5 * last  # the most that an event of the category not met so far can have
    sure = first.groupBy("nid").agg(F.count("*").alias("held"), F.min("score").alias("least")).filter((F.col("held") >= k) & (F.col("least") > unseen))
    open_texts = placed.join(sure.select("nid"), "nid", "left_anti")
    more = (open_texts.join(frequent, "nid").select("nid", "ncat", F.explode("ws").alias("w"))
            .join(often.join(h.select("hid", F.col("hcat").alias("ncat")), "hid"), ["ncat", "w"]).select(*keys).distinct()
            .join(seen.select(*keys), keys, "left_anti").select(*keys, zero.alias("shared"), zero.alias("tagged")))
    out = top(first.drop("rank").unionByName(top(scored(more)).drop("rank")))
    return out.select(F.col("nid").alias(id_col), F.col("hid").alias(history_id), "score", "rank")


RESONANCE_ROWS = 4096


def resonance(news: DataFrame, minutes: float = 5, share: float = 0.30, id_col: str = "news_id",
              ts: str = "captured_at", text: str = "text", title: str = "title",
              include_self: bool = False) -> DataFrame:
    """Number of articles of the last minutes whose title holds more than ``share`` of this
    article's words.

    Titles with the same words in the same second are one row with a count. Articles and titles meet in buckets of
    the length of the window, cut into blocks of bounded size; a group counts shared words by matrices
    and adds up the titles in the window, so no pair ever becomes a row. Times are compared to the second.
    """
    width = int(minutes * 60)
    seconds = F.unix_seconds(F.col(ts))
    bucket = F.floor(seconds / width)
    own = news.select(F.col(id_col).alias("id"), seconds.alias("s"), word_set(F.col(text)).alias("w"), bucket.alias("b")).filter("size(w) > 0")
    cells = (news.select(seconds.alias("s"), F.array_sort(word_set(F.col(title))).alias("tw"), bucket.alias("b"))
             .filter("size(tw) > 0").groupBy("b", "tw", "s").agg(F.count("*").alias("n")))
    cells = checkpoint(cells.select("s", "tw", "n", F.explode(F.array("b", F.col("b") + 1)).alias("b")))
    sizes = (news.select(bucket.alias("b")).groupBy("b").agg(F.ceil(F.count("*") / RESONANCE_ROWS).alias("ps"))
             .join(cells.groupBy("b").agg(F.ceil(F.count("*") / RESONANCE_ROWS).alias("qs")), "b"))
    left = (own.join(sizes, "b").withColumn("p", F.pmod(F.xxhash64("id"), F.col("ps")))
            .select("id", "s", "w", "b", "p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qs") - 1)).alias("q")))
    right = (cells.join(sizes, "b").withColumn("q", F.pmod(F.xxhash64("tw", "s"), F.col("qs")))
             .select("s", "tw", "n", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ps") - 1)).alias("p"), "q"))

    def count(articles: pa.Table, titles: pa.Table) -> pa.Table:
        articles, titles = articles.sort_by("s"), titles.sort_by("s")
        (a_sizes, a_codes), (b_sizes, b_codes) = token_codes(articles["w"], titles["tw"])
        at, times, n = (np.asarray(c).astype(np.int64) for c in (articles["s"], titles["s"], titles["n"]))
        since, until = np.searchsorted(times, at - width, "left"), np.searchsorted(times, at, "right")
        hits = np.zeros(len(at), dtype=np.int64)
        for first, shared in overlap_chunks(a_sizes, a_codes, b_sizes, b_codes):
            rows = slice(first, first + len(shared))
            matches = shared > (a_sizes[rows] * share)[:, None]
            edges = np.flatnonzero(np.diff(at[rows], prepend=at[first] - 1))
            for i, j in zip(edges, [*edges[1:], len(shared)]):  # articles of one second see the same titles
                seen = slice(since[first + i], until[first + i])
                hits[first + i:first + j] = matches[i:j, seen] @ n[seen]
        return pa.table({"id": articles["id"], "hits": pa.array(hits)})

    groups = ["b", "p", "q"]
    kind = news.schema[id_col].dataType.simpleString()
    counted = (left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(count, f"id {kind}, hits bigint")
               .groupBy("id").agg(F.sum("hits").alias("hits")))
    if include_self:
        return news.select(F.col(id_col).alias("id")).join(counted, "id", "left").select(
            F.col("id").alias(id_col), F.coalesce("hits", F.lit(0)).alias("similar_count"))
    # the article's own title is among the cells; it does not count as resonance
    self_hit = F.size(F.array_intersect(word_set(F.col(text)), word_set(F.col(title)))) > F.size(word_set(F.col(text))) * share
    return (news.select(F.col(id_col).alias("id"), F.coalesce(self_hit.cast("int"), F.lit(0)).alias("me"))
            .join(counted, "id", "left")
            .select(F.col("id").alias(id_col),
                    F.greatest(F.coalesce("hits", F.lit(0)) - F.col("me"), F.lit(0)).alias("similar_count")))


def with_entities(news: DataFrame, text: Column, macro=E.MACRO_ALERTS, sectors=E.SECTOR_WORDS,
                  people: dict[str, int] = E.PEOPLE_TIERS, watch=(), found: Found | None = None) -> DataFrame:
    """Add tickers, macro tags, sectors, named people and the people tier from one scan of the text.

    ``found``, where given, answers for ``entity_lists`` of the same dictionaries.
    """
    columns = news.columns
    if found is None:
        news, found = Lexicon(entity_lists(macro=macro, sectors=sectors, people=people)).add(news, F.lower(text), "_entity_codes")
    return news.select(
        *[c for c in columns if c not in ("tickers", "macro_tags")],
        extract_tickers(text, watch=watch, found=found).alias("found_tickers"),
        *([F.col("tickers")] if "tickers" in columns else []),
        tag_words(text, macro, found, "macro").alias("macro_tags"), tag_groups(text, sectors, found, "sectors").alias("sectors"),
        tag_words(text, list(people), found, "people").alias("people"), people_tier(text, people, found).alias("people_tier"),
    ).withColumn("tickers", merge_tags(F.col("tickers"), F.col("found_tickers"))
                 if "tickers" in columns else F.col("found_tickers"))
