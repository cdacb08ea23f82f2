"""Order-dependent rules as streaming folds over sorted partitions.

Used only where each decision depends on the decisions before it (cooldowns, topic
suppression). Suppression folds rows in Arrow batches; memory holds the rule's state, which is bounded by
its time window, never the rows of a key. Debouncing works in chunks whose effects are composed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..runtime import checkpoint


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], new_state: Callable[[], object],
                 step: Callable[[object, dict], dict], added: list[tuple[str, T.DataType]]) -> DataFrame:
    """Append the columns ``step(state, row)`` returns, row by row in ``order`` within ``keys``."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t, True) for n, t in added]])
    names = [n for n, _ in added]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            rows = batch.to_dict("records")
            results = []
            for row in rows:
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, new_state()
                results.append(step(state, row))
            out = batch.copy()
            for name in names:
                out[name] = pd.Series([r[name] for r in results], dtype="object", index=out.index)
            yield out

    return (df.repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema=schema))


# --- debounced alerts --------------------------------------------------------------------------
def debounce_step(state: dict, bad: bool, now: float, n: int, cooldown: float) -> bool:
    """One verdict: alert when n bad ones came in a row and the cooldown has passed."""
    if not bad:
        state["run"] = 0
        return False
    state["run"] = state.get("run", 0) + 1
    if state["run"] >= n and now - state.get("last", float("-inf")) >= cooldown:
        state["last"] = now
        return True
    return False


def _candidates(micros: np.ndarray, bad: np.ndarray, run_before: int, n: int) -> np.ndarray:
    """Places of the rows that end a run of ``n`` bad ones; ``run_before`` bad ones came before the first."""
    good = np.flatnonzero(~bad)
    place = np.arange(len(bad))
    last_good = np.maximum.accumulate(np.where(bad, -1 - run_before, place)) if len(bad) else place
    if len(good) and good[0] > 0:  # rows before the first good one count from the entry
        last_good[:good[0]] = -1 - run_before
    return np.flatnonzero(bad & (place - last_good >= n))


def _next_alert(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For each candidate the first later one that is out of its cooldown; beyond the end: their number."""
    nxt = np.searchsorted(times, times + cooldown, side="left")
    return np.maximum(nxt, np.arange(1, len(times) + 1))  # a cooldown of 0 still moves on


def debounce_alerts(verdicts: DataFrame, key: str = "pipeline", ts: str = "ts",
                    should_alert: str = "should_alert", n: int = 2,
                    cooldown_seconds: int = 3600, tie: str | None = None, chunk_rows: int = 50_000) -> DataFrame:
    """Adds ``alerted``: the n-th bad verdict in a row alerts, unless an alert of the key is within the cooldown.

    A key of any size is cut into chunks of at most ``chunk_rows`` rows in time order. What a chunk inherits is
    the number of bad rows before it, from one-row-per-chunk summaries, and the time of the last alert. For the
    latter a chunk becomes a step map: each of its rows that could alert leads, over the next ones out of its
    cooldown, to the chunk's last alert. The maps of a key are composed in order, then each chunk marks its
    alerts. Rows that cannot alert are handled as arrays only.
    """
    cooldown = int(cooldown_seconds * 1_000_000)
    order = [key, ts] + ([tie] if tie else [])
    mark = F.monotonically_increasing_id()
    in_part = (1 << 33) - 1
    rows = checkpoint(verdicts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", mark)
                      .withColumn("_chunk", F.shiftrightunsigned("_at", 33) * (1 << 28) + F.floor(F.col("_at").bitwiseAND(F.lit(in_part)) / chunk_rows)))
    slim = rows.select(F.col(key).alias("_key"), "_chunk", "_at", F.unix_micros(ts).alias("_us"), F.coalesce(should_alert, F.lit(False)).alias("_bad"))
    # rows of a key are neighbours in a chunk, so places give the length of its last bad run
    tails = (slim.groupBy("_key", "_chunk").agg(F.max(F.when(~F.col("_bad"), F.col("_at"))).alias("good"), F.max("_at").alias("end"), F.count("*").alias("rows"))
             .select("_key", "_chunk", F.col("good").isNull().alias("all_bad"), F.coalesce(F.col("end") - F.col("good"), F.col("rows")).alias("tail")))
    by_chunk = Window.partitionBy("_key").orderBy("_chunk")
    part = tails.withColumn("part", F.sum((~F.col("all_bad")).cast("int")).over(by_chunk))
    opened = part.withColumn("open", F.sum("tail").over(Window.partitionBy("_key", "part").orderBy("_chunk")))
    entries = opened.select("_key", "_chunk", F.coalesce(F.lag("open").over(by_chunk), F.lit(0)).alias("_before"))
    work = slim.filter("_us is not null").join(entries.withColumnRenamed("_key", "_k").withColumnRenamed("_chunk", "_c"),
                                               F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c"))).drop("_k", "_c")

    def able(chunk: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        chunk = chunk.sort_values("_at")
        at = _candidates(chunk["_us"].to_numpy(), chunk["_bad"].to_numpy(bool), int(chunk["_before"].iloc[0]), n)
        return chunk.iloc[at], chunk["_us"].to_numpy()[at]

    def step_map(chunk: pd.DataFrame) -> pd.DataFrame:
        first = chunk.iloc[0]
        _, times = able(chunk)
        jump = np.minimum(_next_alert(times, cooldown), len(times))
        last = np.where(jump < len(times), jump, np.arange(len(times)))
        while len(last) and (last[last] != last).any():  # pointer doubling to the end of each chain
            last = last[last]
        ends = times[last] if len(times) else times
        new = np.flatnonzero(np.diff(ends, append=ends[-1] + 1)) if len(ends) else np.empty(0, np.int64)  # last start of each end
        return pd.DataFrame([{"_key": first["_key"], "_chunk": first["_chunk"], "starts": times[new].tolist(), "ends": ends[new].tolist()}])

    maps = work.groupBy("_key", "_chunk").applyInPandas(step_map, T.StructType([slim.schema["_key"], slim.schema["_chunk"]])
                                                        .add("starts", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType())))

    def compose(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks, last, found = chunks.sort_values("_chunk"), None, []
        for starts, ends in zip(chunks["starts"], chunks["ends"]):
            found.append(last)
            k = 0 if last is None else int(np.searchsorted(starts, last + cooldown, side="left"))
            last = int(ends[k]) if k < len(ends) else last
        return chunks[["_key", "_chunk"]].assign(_last=pd.array(found, dtype="Int64"))

    lasts = maps.groupBy("_key").applyInPandas(compose, T.StructType([slim.schema["_key"], slim.schema["_chunk"]]).add("_last", T.LongType()))
    work = work.join(lasts.withColumnRenamed("_key", "_k").withColumnRenamed("_chunk", "_c"),
                     F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c"))).drop("_k", "_c")

    def alerts(chunk: pd.DataFrame) -> pd.DataFrame:
        last = chunk["_last"].iloc[0]
        hit, times = able(chunk)
        nxt, k, out = _next_alert(times, cooldown), 0 if pd.isna(last) else int(np.searchsorted(times, int(last) + cooldown, side="left")), []
        while k < len(times):
            out.append(k)
            k = int(nxt[k])
        return hit.iloc[out][["_at"]]

    fired = work.groupBy("_key", "_chunk").applyInPandas(alerts, T.StructType([slim.schema["_at"]])).withColumn("alerted", F.lit(True))
    return rows.join(fired, "_at", "left").select(*verdicts.columns, F.coalesce("alerted", F.lit(False)).alias("alerted"))


# --- topic suppression -------------------------------------------------------------------------
SIMILAR_HEADLINE = 0.22


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def suppression_step(log: dict, key, now: float, intensity: int, tags: set, tokens: set,
                     window: float, by_intensity: bool) -> tuple[bool, str]:
    """Decide one alert against the log of passed ones; returns (pass, reason).

    ``log`` maps key -> (time, intensity, tags, tokens) and forgets what left the window.
    """
    if key is None:
        return True, "no_key"
    for old in [k for k, v in log.items() if now - v[0] >= window]:
        del log[old]

    def settle(previous: int, reason: str) -> tuple[bool, str]:
        if by_intensity and intensity > previous:
            log[key] = (now, intensity, tags, tokens)
            return True, "intensity_upgrade"
        return False, reason

    if key in log:
        return settle(log[key][1], "same_topic")
    if by_intensity and tags:
        for seen in log.values():
            if tags & seen[2]:
                return settle(seen[1], "strategic_tag")
    for seen in log.values():
        if _overlap(tokens, seen[3]) >= SIMILAR_HEADLINE:
            return settle(seen[1], "similar_headline")
    log[key] = (now, intensity, tags, tokens)
    return True, "new_topic"


def suppress_topics(alerts: DataFrame, window_seconds: int = 24 * 3600, by_intensity: bool = True,
                    recipient: str = "recipient", ts: str = "ts", id_col: str = "id",
                    key: str = "dedup_key", tokens: str = "tokens", tags: str = "strategic_tags",
                    intensity: str = "intensity") -> DataFrame:
    """Adds ``passed`` and ``suppress_reason``. Phone rule by default; for the chat channel use
    ``window_seconds=300, by_intensity=False``.

    The work is spread over recipients (one per person and channel).
    """
    def step(log, row):
        ok, reason = suppression_step(
            log, row[key], row[ts].timestamp(), int(row[intensity] or 0),
            set(row[tags] if row[tags] is not None else ()),
            set(row[tokens] if row[tokens] is not None else ()), window_seconds, by_intensity)
        return {"passed": ok, "suppress_reason": reason}
    return ordered_fold(alerts, [recipient], [ts, id_col], dict, step,
                        [("passed", T.BooleanType()), ("suppress_reason", T.StringType())])
