import random

import pytest
from pyspark.sql import functions as F

from retentia.streaming import access, limits, loop

SCHEMA = "key long, at timestamp, kind string"


def written(spark, folder):
    kinds = ["purchase", "error", "view", "click", "purchase"]
    rows = spark.range(60).select(
        (F.col("id") % 4).alias("key"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("at"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 5 + 1).cast("int")).alias("kind")
    )
    rows.orderBy("at").coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_counters_equal_batch(spark, tmp_path):
    batch = written(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = access.counters(stream, F.col("key"), "kind", "at").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    drained(q)
    assert set(spark.table("counted").collect()) == set(access.counters(batch, F.col("key"), "kind", "at").collect())


def test_stream_windows_equal_batch(spark, tmp_path):
    batch = written(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = access.windowed(stream, "at", "kind", F.window("at", "2 hours")).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    drained(q)
    assert set(spark.table("windows").collect()) == set(access.windowed(batch, "at", "kind", F.window("at", "2 hours")).collect())


def test_closed_loop_stream_equals_batch(spark, tmp_path):
    batch = written(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    looped = stream.groupBy("key").applyInPandasWithState(access.closed_loop, access.CLOSED_LOOP, "success_count long, failure_count long", "append", "NoTimeout")
    q = looped.writeStream.outputMode("append").format("memory").queryName("looped").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c3").start()
    drained(q)
    twin = batch.groupBy("key").applyInPandas(access.closed_loop_batch, access.CLOSED_LOOP)
    assert set(spark.table("looped").collect()) == set(twin.collect())


def started(df, name, folder):
    return df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}").start()


def test_closed_loop_sorts_a_trigger_whatever_its_batches(spark, tmp_path):
    """Thirty mixed rows a key, in Arrow batches of seven."""
    rows = spark.range(120).select(
        (F.col("id") % 4).alias("key"), F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(10**6))).alias("at"), F.element_at(F.array(*map(F.lit, ("purchase", "error", "error"))), (F.col("id") % 3 + 1).cast("int")).alias("kind")
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        drained(started(access.feedback_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "30 days"), "mixed", tmp_path))
        twin = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").groupBy("key").applyInPandas(access.closed_loop_batch, access.CLOSED_LOOP).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(spark.table("mixed").collect()) == set(twin) and len(twin) == 120


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h: F.timestamp_seconds(F.lit(1704067200 + h * 3600))
    for n, hours in enumerate(((0, 10), (1, 12), (20,))):
        df = None
        for h in hours:
            one = spark.range(1).select(F.lit(1).cast("long").alias("key"), at(h).alias("at"), F.lit("view").alias("kind"))
            df = one if df is None else df.unionByName(one)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counted = access.windowed(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "at", "kind", F.window("at", "1 hour"))
        drained(counted.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/late").start())
    got = sorted(r["start"].hour for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [0, 10, 12]  # the row of hour 1 came after the watermark had reached hour 9


def test_limiter_by_hand():
    l = limits.Limiter(2, 100, 60_000_000)
    s = 1_000_000
    assert l.admit(0, 60) == (True, 0.0)
    assert l.admit(10 * s, 60) == (False, 50.0)  # tokens: waits for the first to leave
    assert l.admit(20 * s, 40) == (True, 0.0)
    assert l.admit(30 * s, 1) == (False, 30.0)  # requests
    assert l.admit(60 * s, 500) == (False, 20.0)  # the first has left; the whole budget waits for an empty window
    assert l.admit(80 * s, 500) == (True, 0.0)


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = spark.range(90).select((F.col("id") % 3).alias("key"), F.col("id").alias("request"), (F.pmod(F.xxhash64("id"), F.lit(600)) * 1000000).alias("micros"), (F.col("id") % 50).alias("tokens"))
    rows = rows.withColumn("at", F.timestamp_micros("micros"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    drained(started(limits.admit_stream(stream, 3, 80, 60_000_000), "limited", tmp_path))
    want = limits.admitted(rows, 3, 80, 60_000_000).collect()
    assert set(spark.table("limited").collect()) == set(want) and len({r["admitted"] for r in want}) == 2


def contexts(spark):
    rng = random.Random(5)
    words = "lamp key barn violin ferry market cheese winter ledger parrot".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(8))
    rows = [(i, [(text() if j % 7 else None, None if j % 5 == 4 else 1.7e9 + 3600.0 * (j // 2)) for j in range(12)], [text() for _ in range(4)] + [None]) for i in range(5)]
    return spark.createDataFrame([*rows, (5, None, ["x"]), (6, [], None)], "context_id long, units array<struct<text string, unit_ts double>>, questions array<string>")


@pytest.mark.parametrize("policy", ["retention", "lru", "lfu", "fifo", "random", "forgetting", "agents"])
def test_loop_keeps_its_capacity(spark, policy):
    got = loop.run_contexts(contexts(spark), 0.5, policy).collect()
    assert {r["context_id"] for r in got} == {0, 1, 2, 3, 4, 5} and all(r["stored"] <= 6 and r["n_good"] <= len(r["shown"]) for r in got)
    assert any(r["evicted"] for r in got) and any(r["n_good"] for r in got)


def test_feedback_changes_what_is_shown(spark):
    c = contexts(spark)
    closed, open_ = ({(r["context_id"], r["question_no"]): r["shown"] for r in loop.run_contexts(c, None, feedback=f).collect()} for f in (loop.lexical, loop.none))
    assert closed.keys() == open_.keys() and closed != open_
    assert all(sorted(closed[k]) == sorted(open_[k]) for k in closed)  # with room for all, the same units in another order


def test_first_evicted_is_the_least_recent():
    l = loop.Loop(2, "lru")
    l.ingest([(0, "a")], 0.0)
    l.ingest([(1, "b")], 1.0)
    l.ingest([(2, "c")], 2.0)
    assert sorted(l.rows) == [1, 2] and l.evicted == 1


def test_loop_stream_equals_batch(spark, tmp_path):
    c = contexts(spark)
    e = loop.events_of(c)
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    drained(started(loop.stream_contexts(stream, 0.5), "looping", tmp_path))
    row = lambda r: (*r[:5], tuple(r["shown"]), r["n_good"])
    assert set(map(row, spark.table("looping").collect())) == set(map(row, loop.run_contexts(c, 0.5).collect()))
