"""Batch twins of the streaming operators over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.plans.common import COMP, scored
from retentia.plans.registry import Registry
from retentia.plans.state import EVENTS, event_counts
from retentia.sources.tables import table
from retentia.streaming import access, limits, loop

registry = Registry()
add = registry.add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@add("events_state", f"WITH {EVENTS} SELECT key, success_count, failure_count, frequency, recency_ts, created_ts FROM counts")
def events_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(spark, sf_dir)


@add(
    "tumbling_access",
    "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' AS \"end\", event_type, count(*)::bigint AS n FROM events GROUP BY ALL",
)
def tumbling_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.windowed(_events(spark, sf_dir), "ts", "event_type", F.window("ts", "1 day"))


@add(
    "sliding_access",
    """WITH b AS (SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours' * i AS start FROM events, range(0, 4) t(i)) SELECT start, start + INTERVAL '1 day' AS "end", event_type, count(*)::bigint AS n FROM b GROUP BY ALL""",
)
def sliding_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.windowed(_events(spark, sf_dir), "ts", "event_type", F.window("ts", "1 day", "6 hours"))


@add(
    "session_access",
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL '12 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*)::bigint AS n FROM s GROUP BY user_id, sid""",
)
def session_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user that end after twelve idle hours."""
    return access.windowed(_events(spark, sf_dir), "ts", "user_id", F.session_window("ts", "12 hours")).select("user_id", "start", "end", "n")


#: Requests and tokens that a user may have in a window of so many microseconds.
RATE_REQUESTS, RATE_TOKENS, RATE_WINDOW = 3, 120, 86_400_000_000

_LIVE = f"list_filter(r.live, lambda e: k.micros - e.t < {RATE_WINDOW})"
_ADMIT = f"(len(w.live) < {RATE_REQUESTS} AND w.used + w.tokens <= {RATE_TOKENS})"


@add(
    "rate_window",
    f"""WITH RECURSIVE k AS (SELECT user_id AS key, event_id AS request, epoch_us(ts) AS micros, floor(coalesce(value, 0))::bigint AS raw, greatest(0, least(floor(coalesce(value, 0))::bigint, {RATE_TOKENS})) AS tokens,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
    rec AS (SELECT key, request, micros, raw, nth, [{{'t': micros, 'k': tokens}}] AS live, true AS admitted, 0e0 AS wait FROM k WHERE nth = 1
      UNION ALL SELECT w.key, w.request, w.micros, w.raw, w.nth, CASE WHEN {_ADMIT} THEN list_append(w.live, {{'t': w.micros, 'k': w.tokens}}) ELSE w.live END, {_ADMIT},
        CASE WHEN {_ADMIT} THEN 0e0 ELSE coalesce(list_min(list_transform(list_filter(range(1, len(w.live) + 1), lambda i: len(w.live) - i < {RATE_REQUESTS} AND coalesce(list_sum(list_transform(w.live[i + 1:], lambda e: e.k)), 0) + w.tokens <= {RATE_TOKENS}),
          lambda i: greatest(w.live[i].t + {RATE_WINDOW} - w.micros, 1000) / 1e6)), {RATE_WINDOW} / 1e6) END
      FROM (SELECT k.*, {_LIVE} AS live, coalesce(list_sum(list_transform({_LIVE}, lambda e: e.k)), 0) AS used FROM rec r JOIN k ON k.key = r.key AND k.nth = r.nth + 1) w)
    SELECT key AS user_id, request AS event_id, raw::bigint AS tokens, admitted, wait FROM rec""",
)
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of a user fit under three requests and 120 tokens a day, counting the admitted only, and how long others wait."""
    at = F.unix_micros("ts")
    e = _events(spark, sf_dir).select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("request"), at.alias("micros"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("tokens"))
    done = limits.admitted(e, RATE_REQUESTS, RATE_TOKENS, RATE_WINDOW)
    return done.select(F.col("key").alias("user_id"), F.col("request").alias("event_id"), "tokens", "admitted", "wait")


@add(
    "rate_usage",
    """WITH e AS (SELECT user_id, event_id, epoch(ts)::bigint AS s FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events)) SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)::bigint AS used FROM e""",
)
def rate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within the last hour, at each event, admitted or not."""
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3599, 0)
    return _events(spark, sf_dir).select("user_id", "event_id", F.unix_seconds("ts").alias("s")).select("user_id", "event_id", F.count("*").over(w).alias("used"))


@add("coalesce_requests", "SELECT sha256(body) AS key, count(*)::bigint AS waiting, min(received_at) AS first FROM collected_requests WHERE body IS NOT NULL GROUP BY 1")
def coalesce_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical requests that one answer serves."""
    r = table(spark, sf_dir, "collected_requests").where("body IS NOT NULL")
    return r.groupBy(F.sha2("body", 256).alias("key")).agg(F.count("*").alias("waiting"), F.min("received_at").alias("first"))


@add("oracle_verdict", f"WITH {COMP} SELECT memory_id, CASE WHEN frequency >= 5 THEN 'YES' WHEN frequency = 0 THEN 'NEUTRAL' ELSE 'NO' END AS verdict FROM scored")
def oracle_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("frequency")
    return scored(spark, sf_dir).select("memory_id", F.when(f >= 5, "YES").when(f == 0, "NEUTRAL").otherwise("NO").alias("verdict"))


@add("closed_loop_feedback")
def closed_loop_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed loop of each user over the whole event table: sequential in a key, parallel across keys."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return e.groupBy("key").applyInPandas(access.closed_loop_batch, access.CLOSED_LOOP)


def _loops(name: str, doc: str, **options) -> None:
    @add(name)
    def looped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return loop.run_contexts(table(spark, sf_dir, "contexts"), **options)

    looped.__doc__ = doc


_loops("context_loop", "Every context's questions in the closed loop with room for half its units: ingest, evict, rank, show, feed back.")
_loops("context_loop_open", "The same without eviction and without feedback.", share=None, feedback=loop.none)
_loops("context_loop_noisy", "The closed loop with a fifth of the verdicts turned round.", feedback=loop.noisy(0.2))


@add("context_loop_policies")
def context_loop_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, mean share of shown units that helped, and units evicted, by eviction policy, over all contexts."""
    each = None
    for policy in ("retention", "lru", "lfu", "fifo", "random", "forgetting", "agents"):
        one = loop.run_contexts(table(spark, sf_dir, "contexts"), policy=policy).withColumn("policy", F.lit(policy))
        each = one if each is None else each.unionByName(one)
    return each.groupBy("policy").agg(
        F.count("*").alias("questions"), F.round(F.avg(F.when(F.size("shown") > 0, F.col("n_good") / F.size("shown"))), 6).alias("helped"), F.sum("n_good").alias("n_good"),
    )
