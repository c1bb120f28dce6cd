"""Admission under a sliding window of requests and tokens: only what was admitted counts."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "key long, request long, micros long, tokens long, admitted boolean, wait double"
_COLUMNS = ["key", "request", "micros", "tokens", "admitted", "wait"]


class Limiter:
    """The admitted requests of the last `window` microseconds; an event leaves once it is `window` old."""

    def __init__(self, requests: int, tokens: int, window: int):
        self.requests, self.tokens, self.window = requests, tokens, window
        self.live: deque[tuple[int, int]] = deque()

    def admit(self, now: int, tokens: int) -> tuple[bool, float]:
        """(admitted, seconds to wait). A request larger than the whole budget counts as the budget."""
        tokens = max(0, min(tokens, self.tokens))
        while self.live and now - self.live[0][0] >= self.window:
            self.live.popleft()
        n, used = len(self.live), sum(t for _, t in self.live)
        if n < self.requests and used + tokens <= self.tokens:
            self.live.append((now, tokens))
            return True, 0.0
        for at, t in self.live:
            n, used = n - 1, used - t
            if n < self.requests and used + tokens <= self.tokens:
                return False, max(at + self.window - now, 1000) / 1e6
        return False, self.window / 1e6


def _advance(rows: pd.DataFrame, limiter: Limiter) -> pd.DataFrame:
    rows = rows.sort_values(["micros", "request"])
    out = [(k, r, m, t, *limiter.admit(m, t)) for k, r, m, t in zip(*(rows[c].tolist() for c in _COLUMNS[:4]))]
    return pd.DataFrame(out, columns=_COLUMNS)


def admitted(requests_: DataFrame, requests: int, tokens: int, window: int) -> DataFrame:
    """RESULT of a table (key, request, micros, tokens): each key's requests in order of time, as one sorted stream a task.

    A task holds the admitted requests of one window only, whatever the key's size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter = run, None  # no key is called `run`
        for pdf in batches:
            out = []
            for k, r, m, t in zip(*(pdf[c].tolist() for c in _COLUMNS[:4])):
                if k != key:
                    key, limiter = k, Limiter(requests, tokens, window)
                out.append((k, r, m, t, *limiter.admit(m, t)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    slim = requests_.select(*_COLUMNS[:4])
    return slim.repartition("key").sortWithinPartitions("key", "micros", "request").mapInPandas(run, RESULT)


def admit_stream(stream: DataFrame, requests: int, tokens: int, window: int, late: str = "1 hour") -> DataFrame:
    """RESULT over a stream with an event time `at` beside the columns of `admitted`; a key's state ends with its window."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        limiter = Limiter(requests, tokens, window)
        if state.exists:
            limiter.live.extend(map(tuple, json.loads(state.get[0])))
        out = _advance(rows, limiter)
        state.update((json.dumps(list(limiter.live)),))
        state.setTimeoutTimestamp(max(int(rows["micros"].max()) // 1000, state.getCurrentWatermarkMs()) + window // 1000 + 1)
        yield out

    return stream.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, RESULT, "live string", "append", GroupStateTimeout.EventTimeTimeout)
