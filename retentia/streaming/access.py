"""Streams of access events: counters, windows with watermarks, and the closed loop per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def windowed(events: DataFrame, at: str, kind: str, window: Column, late: str = LATE) -> DataFrame:
    """(start, end, kind, n) over event-time windows; on a stream, rows later than `late` are dropped."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def counters(events: DataFrame, key: Column, kind: str, at: str) -> DataFrame:
    """Success, failure and access counts and the last time of each key; the same plan on a stream (update mode) and a batch."""
    n = lambda *kinds: F.sum(F.when(F.col(kind).isin(*kinds), 1).otherwise(0))
    return events.groupBy(key.alias("key")).agg(
        n("purchase").alias("success_count"), n("error").alias("failure_count"), n("view", "click").alias("frequency"), F.max(at).alias("last_at")
    )


CLOSED_LOOP = "key long, at timestamp, shown int, success_count long, failure_count long"


def closed_loop(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State update of one key: what is shown follows the success rate so far, and the event decides what is learnt.

    For applyInPandasWithState with the state (success_count long, failure_count long); `closed_loop_batch` gives the
    same rows over a whole table. A trigger's rows of the key are gathered and sorted once, however many batches they
    come in. With an event-time timeout (`feedback_stream`) the state of a silent key ends.
    """
    if state.hasTimedOut:
        state.remove()
        return
    success, failure = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches))
    out, success, failure = _advance(rows, success, failure)
    state.update((success, failure))
    if state._timeout_conf == "EventTimeTimeout":
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)
    yield out.assign(key=key[0])[["key", "at", "shown", "success_count", "failure_count"]]


#: Milliseconds of event time after which a silent key's state ends.
IDLE_MS = 30 * 86_400_000


def feedback_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """`closed_loop` over a stream (key, at, kind): rows later than `late` are dropped, silent keys forgotten."""
    marked = events.withWatermark("at", late)
    return marked.groupBy("key").applyInPandasWithState(closed_loop, CLOSED_LOOP, "success_count long, failure_count long", "append", "EventTimeTimeout")


def _advance(rows: pd.DataFrame, success: int, failure: int) -> tuple[pd.DataFrame, int, int]:
    out = []
    for at, kind in sorted(zip(rows["at"], rows["kind"])):
        shown = int((success + 1) / (success + failure + 2) >= 0.5)
        if shown:
            success, failure = success + (kind == "purchase"), failure + (kind == "error")
        out.append((at, shown, success, failure))
    return pd.DataFrame(out, columns=["at", "shown", "success_count", "failure_count"]), success, failure


def closed_loop_batch(rows: pd.DataFrame) -> pd.DataFrame:
    """The batch twin for groupBy(key).applyInPandas."""
    out, _, _ = _advance(rows, 0, 0)
    return out.assign(key=rows["key"].iloc[0] if len(rows) else 0)[["key", "at", "shown", "success_count", "failure_count"]]
