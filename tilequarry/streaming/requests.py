"""Request streams: debouncing, latest-wins and the staging gate, for batches and for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(requests: DataFrame, gap: str) -> DataFrame:
    """Of session, request, ts the requests that no other one of the session follows within the gap."""
    following = F.lead("ts").over(Window.partitionBy("session").orderBy("ts", "request"))
    return requests.withColumn("next_ts", following).where(F.col("next_ts").isNull() | (F.col("next_ts") - F.col("ts") >= F.expr(f"interval {gap}"))).drop("next_ts")


def latest(requests: DataFrame) -> DataFrame:
    """session, request (the highest, which wins) and the number of stale ones."""
    return requests.groupBy("session").agg(F.max("request").alias("request"), (F.count(F.lit(1)) - 1).alias("stale"))


def debounced_stream(requests: DataFrame, gap: str, late: str) -> DataFrame:
    """The same for a stream: a session window closes after the gap, and its last request is given once."""
    return (
        requests.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap)).agg(F.max_by("request", F.struct("ts", "request")).alias("request"))
        .select("session", "request", F.col("session_window.end").alias("due"))
    )


def run_latest(stream: DataFrame, search: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that gives each micro-batch's newest request of a session to `search`; older ones are dropped.

    Spark jobs of a batch carry the tag `search`, so that spark.interruptTag('search') aborts a running one.
    """

    def each(batch: DataFrame, _: int) -> None:
        batch.sparkSession.addTag("search")
        try:
            search(latest(batch))
        finally:
            batch.sparkSession.removeTag("search")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


#: Sessions whose state is kept together, in so many groups: a call of Python costs milliseconds, however few rows it gets.
BUCKETS = 2048


def staging_gate(events: DataFrame) -> DataFrame:
    """session, request, at: when each request of a stream may run.

    events: session, request, ts and staged (true: the session's image is ready now; a request otherwise). Before that a session
    keeps its newest request, older ones are stale and dropped; the one kept runs when the image is staged, and later ones at once.
    State is four numbers a session, by groups of sessions. A batch's rows go by time, then request; batches go as they arrive.
    """

    def step(key, frames, state):
        # Rows of the state: sessions, ascending; whether they are open; whether a request waits; which.
        known = np.frombuffer(bytes(state.get[0]), dtype=np.int64).reshape(4, -1) if state.exists else np.zeros((4, 0), dtype=np.int64)
        parts = list(frames)
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        session, ts, request, staged = (rows[c].to_numpy() for c in ("session", "ts", "request", "staged"))
        order = np.lexsort((request, ts, session))
        session, ts, request, staged = session[order], ts[order], request[order], staged[order].astype(bool)
        at = np.arange(len(session))
        own, start, of = np.unique(session, return_index=True, return_inverse=True)
        end = np.append(start[1:], len(session))
        held, place = np.zeros((4, len(own)), dtype=np.int64), np.searchsorted(known[0], own)
        seen = place < known.shape[1]
        seen[seen] = known[0][place[seen]] == own[seen]
        held[1:, seen] = known[1:, place[seen]]
        is_open, waits, parked = held[1] > 0, held[2] > 0, held[3]
        first = np.minimum(np.minimum.reduceat(np.where(staged, at, len(at)), start), end)  # the row that stages a session's image
        early, opened = ~is_open & (first > start), ~is_open & (first < end)
        parked, waits = np.where(early, request[np.maximum(first, 1) - 1], parked), waits | early
        runs = ~staged & (at > np.where(is_open, start - 1, first)[of])
        go, request = first[opened & waits], request.copy()  # what waits runs in the place of that row
        request[go], runs[go] = parked[opened & waits], True
        now = np.stack([own, is_open | opened, waits & ~opened, parked]).astype(np.int64)
        kept = np.concatenate([known[:, ~np.isin(known[0], own)], now], axis=1)
        state.update((kept[:, np.argsort(kept[0])].tobytes(),))
        if runs.any():
            yield pd.DataFrame({"session": session[runs], "request": request[runs], "at": ts[runs]})

    grouped = events.where("session IS NOT NULL").select("session", "request", "ts", "staged", F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).alias("bucket")).groupBy("bucket")
    return grouped.applyInPandasWithState(step, "session long, request long, at timestamp", "sessions binary", "append", "NoTimeout")
