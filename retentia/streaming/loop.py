"""The closed loop of one context: units are stored and evicted, questions rank what is stored, feedback changes the counters.

What is shown depends on the feedback that earlier showings caused, so a context is a sequence; contexts run side by
side. The same `Loop` runs over a table of contexts, a row each and without a shuffle, and over a keyed stream, whose
state is the loop written as JSON and is dropped when a context has been silent for long.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions import score as S
from retentia.functions.providers import hashed_text

_WORD = re.compile("[a-z0-9]+")
#: Candidates that are fused, constant of the fusion, tokens a memory costs beside its words.
FETCH_K, RRF_K, OVERHEAD = 15, 60, 5
#: Seconds between two questions of a context, and F1 from which a shown unit counts as good.
QUESTION_STEP, GOOD = 3600.0, 0.2

RESULT = "context_id long, question_no int, at double, stored int, evicted int, shown array<int>, n_good int"


def word_f1(a: str, b: str) -> float:
    x, y = Counter(_WORD.findall(a.lower())), Counter(_WORD.findall(b.lower()))
    shared = sum((x & y).values())
    return 2.0 * shared / (sum(x.values()) + sum(y.values())) if shared else 0.0


#: Feedback sources: (question, text, unit) -> whether it helped, None for no verdict.
def lexical(question: str, text: str, unit: int) -> bool | None:
    return word_f1(question, text) >= GOOD


def none(question: str, text: str, unit: int) -> bool | None:
    return None


def noisy(share: float, seed: int = 7, source: Callable = lexical) -> Callable:
    """`source` with a share of its verdicts turned round, drawn from a hash so that every run agrees."""

    def verdict(question: str, text: str, unit: int) -> bool | None:
        v = source(question, text, unit)
        draw = int(hashlib.md5(f"{seed}:{question}:{unit}".encode()).hexdigest()[:8], 16) / 2**32
        return v if v is None or draw >= share else not v

    return verdict


def asymmetric(miss: float, false: float, seed: int = 7, source: Callable = lexical) -> Callable:
    """`source` whose good verdicts are missed and bad ones turned good at different rates."""

    def verdict(question: str, text: str, unit: int) -> bool | None:
        v = source(question, text, unit)
        draw = int(hashlib.md5(f"{seed}:{question}:{unit}".encode()).hexdigest()[:8], 16) / 2**32
        return v if v is None or draw >= (miss if v else false) else not v

    return verdict


class Loop:
    """The memories of one context."""

    def __init__(self, capacity: int | None, policy: str = "retention", budget: int = 512, feedback: Callable = lexical, show: str = "rrf"):
        if policy not in ("retention", "lru", "lfu", "fifo", "random", "forgetting", "agents"):
            raise ValueError(f"unknown policy {policy}")
        self.capacity, self.policy, self.budget, self.feedback, self.show = capacity, policy, budget, feedback, show
        self.rows: dict[int, dict] = {}
        self.evicted = 0

    def ingest(self, units: list[tuple[int, str]], at: float) -> None:
        """Stores units of one moment, then evicts down to the capacity."""
        for no, text in units:
            self.rows[no] = {"text": text, "s": 0, "f": 0, "n": 0, "at": at, "created": at, "vec": None}
        over = len(self.rows) - self.capacity if self.capacity is not None else 0
        if over > 0:
            keys = self.keys(at)
            for no in sorted(self.rows, key=lambda u: (keys[u], hashlib.md5(f"evict:{u}".encode()).hexdigest(), u))[:over]:
                del self.rows[no]
            self.evicted += over

    def score(self, r: dict, now: float) -> float:
        age = math.exp(-S.DECAY * max(now - r["at"], 0.0) / 3600.0)
        often = min(math.log(1.0 + r["n"]) / math.log(1.0 + S.FREQUENCY_CAP), 1.0)
        w = S.WEIGHTS
        total = w["r"] * age + w["f"] * often + w["u"] * (r["s"] + 1.0) / (r["s"] + r["f"] + 2.0) + w["p"] * 0.5
        return math.floor(min(max(total, 0.0), 1.0) * 1e6 + 0.5) / 1e6

    def keys(self, now: float) -> dict[int, float]:
        """What each memory is worth to the policy; the lowest go first."""
        days = lambda r: max(now - r["at"], 0.0) / 86400.0
        plain = {
            "retention": lambda r: self.score(r, now), "lru": lambda r: r["at"], "lfu": lambda r: float(r["n"]), "fifo": lambda r: r["created"],
            "random": lambda r: 0.0, "forgetting": lambda r: math.exp(-days(r) / (1.0 + r["n"])),
        }
        if self.policy != "agents":
            return {u: plain[self.policy](r) for u, r in self.rows.items()}
        fresh = {u: 0.995 ** (days(r) * 24.0) for u, r in self.rows.items()}
        weight = {u: float(len(_WORD.findall(r["text"].lower()))) for u, r in self.rows.items()}
        scaled = lambda x: {u: (v - min(x.values())) / (max(x.values()) - min(x.values())) if max(x.values()) > min(x.values()) else 0.0 for u, v in x.items()}
        a, b = scaled(fresh), scaled(weight)
        return {u: a[u] + b[u] for u in self.rows}

    def ranked(self, question: str, now: float) -> list[int]:
        """Units by similarity, the first FETCH_K of them fused with the score; equals keep the order of similarity."""
        numbers: dict[str, int] = {}
        q = hashed_text(question, numbers, 64)
        units = sorted(self.rows)
        if not units:
            return []
        for u in units:
            if self.rows[u]["vec"] is None:
                self.rows[u]["vec"] = hashed_text(self.rows[u]["text"], numbers, 64)
        x = np.stack([self.rows[u]["vec"] for u in units])
        norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q)
        sims = np.round(np.divide(x @ q, norms, out=np.zeros(len(units)), where=norms > 0), 9)
        order = [units[i] for i in np.lexsort((units, -sims))]
        if self.show == "similarity":
            return order
        head = order[:FETCH_K]
        by_score = {u: k for k, u in enumerate(sorted(head, key=lambda u: -self.score(self.rows[u], now)), 1)}
        fused = {u: round(1.0 / (RRF_K + k) + 1.0 / (RRF_K + by_score[u]), 9) for k, u in enumerate(head, 1)}
        return sorted(head, key=lambda u: -fused[u]) + order[FETCH_K:]

    def ask(self, question: str, at: float) -> tuple[int, int, list[int], int]:
        """(stored, evicted so far, units shown, how many of them helped); verdicts move counters, recency and frequency."""
        shown, used = [], 0
        for u in self.ranked(question, at):
            used += len(_WORD.findall(self.rows[u]["text"].lower())) + OVERHEAD
            if used > self.budget:
                break
            shown.append(u)
        stored, good = len(self.rows), 0
        for u in shown:
            v = self.feedback(question, self.rows[u]["text"], u)
            if v is None:
                continue
            good += v
            r = self.rows[u]
            r["s"], r["f"], r["n"], r["at"] = r["s"] + v, r["f"] + (not v), r["n"] + 1, at
        return stored, self.evicted, shown, int(good)

    def dump(self) -> str:
        return json.dumps([self.evicted, self.capacity, [[u, r["text"], r["s"], r["f"], r["n"], r["at"], r["created"]] for u, r in self.rows.items()]])

    def load(self, text: str) -> Loop:
        self.evicted, self.capacity, rows = json.loads(text)
        self.rows = {u: {"text": t, "s": s, "f": f, "n": n, "at": a, "created": c, "vec": None} for u, t, s, f, n, a, c in rows}
        return self


def schedule(units: list, questions: list) -> list[tuple[float, int, list]]:
    """(time, 0, [(unit, text)]) and (time, 1, [(question number, question)]) of a context in order.

    Units of one moment are one batch; those without a time come with the earliest. Questions follow the last unit, a
    step apart. Null texts aren't stored.
    """
    times = [u["unit_ts"] for u in units if u["unit_ts"] is not None]
    first, last = (min(times), max(times)) if times else (0.0, 0.0)
    batches: dict[float, list] = {}
    for no, u in enumerate(units):
        if u["text"] is not None:
            batches.setdefault(first if u["unit_ts"] is None else u["unit_ts"], []).append((no, u["text"]))
    events = [(t, 0, batch) for t, batch in sorted(batches.items())]
    return events + [(last + (k + 1) * QUESTION_STEP, 1, [(k, q)]) for k, q in enumerate(questions) if q is not None]


def capacity_of(n_units: int, share: float | None) -> int | None:
    return None if share is None else max(1, math.ceil(share * n_units))


def run_contexts(contexts: DataFrame, share: float | None = 0.5, policy: str = "retention", feedback: Callable = lexical, show: str = "rrf") -> DataFrame:
    """RESULT of every context (context_id, units, questions): one row a question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for context, units, questions in zip(pdf.context_id, pdf.units, pdf.questions):
                units, questions = [u for u in (units if units is not None else ()) if u is not None], list(questions) if questions is not None else []
                loop = Loop(capacity_of(len(units), share), policy, feedback=feedback, show=show)
                for at, kind, what in schedule(units, questions):
                    if kind == 0:
                        loop.ingest(what, at)
                    else:
                        stored, gone, shown, good = loop.ask(what[0][1], at)
                        out.append((context, what[0][0], at, stored, gone, shown, good))
            yield pd.DataFrame(out, columns=["context_id", "question_no", "at", "stored", "evicted", "shown", "n_good"])

    return contexts.select("context_id", "units", "questions").mapInPandas(run, RESULT)


def events_of(contexts: DataFrame) -> DataFrame:
    """The contexts as a stream's rows: (context_id, at timestamp, seconds, kind, n_units, no, text)."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for context, units, questions in zip(pdf.context_id, pdf.units, pdf.questions):
                units, questions = [u for u in (units if units is not None else ()) if u is not None], list(questions) if questions is not None else []
                for at, kind, what in schedule(units, questions):
                    out += [(context, at, kind, len(units), no, text) for no, text in what]
            yield pd.DataFrame(out, columns=["context_id", "seconds", "kind", "n_units", "no", "text"])

    rows = contexts.select("context_id", "units", "questions").mapInPandas(spread, "context_id long, seconds double, kind int, n_units int, no int, text string")
    return rows.withColumn("at", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")))


def stream_contexts(events: DataFrame, share: float | None = 0.5, policy: str = "retention", idle: str = "1 day") -> DataFrame:
    """RESULT over a stream of `events_of` rows; `idle` is how late rows may be and how long a silent context is kept.

    A trigger's rows of a context are gathered and sorted before the loop goes on, so their order in batches plays no part.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        rows = rows.sort_values(["seconds", "kind", "no"])
        loop = Loop(capacity_of(int(rows["n_units"].iloc[0]), share), policy)
        if state.exists:
            loop.load(state.get[0])
        out = []
        for (at, kind), part in rows.groupby(["seconds", "kind"], sort=True):
            what = list(zip(part["no"].tolist(), part["text"].tolist()))
            if kind == 0:
                loop.ingest(what, at)
                continue
            for no, question in what:
                stored, gone, shown, good = loop.ask(question, at)
                out.append((key[0], no, at, stored, gone, shown, good))
        state.update((loop.dump(),))
        state.setTimeoutTimestamp(max(int(rows["seconds"].max() * 1000), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=["context_id", "question_no", "at", "stored", "evicted", "shown", "n_good"])

    marked = events.withWatermark("at", idle)
    return marked.groupBy("context_id").applyInPandasWithState(step, RESULT, "loop string", "append", GroupStateTimeout.EventTimeTimeout)
