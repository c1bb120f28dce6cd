"""Sources, ingestion and mutation of the memory table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.functions import score as S
from retentia.operators import memory
from retentia.plans.common import COMP, MEM, NOW, memories, scored
from retentia.plans.registry import Registry
from retentia.plans.scoring import ACTION_SQL, action
from retentia.sources.tables import table

registry = Registry()
add = registry.add


@add("scan_memories", "SELECT memory_id, text_content, frequency, version FROM memory_points")
def scan_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored rows without vectors; pruning keeps those columns unread."""
    return table(spark, sf_dir, "memory_points").select("memory_id", "text_content", "frequency", "version")


@add("point_lookup", "SELECT cache_key, dim FROM vector_cache WHERE cache_key = (SELECT min(cache_key) FROM vector_cache)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by key; the filter reaches the parquet reader."""
    cache = table(spark, sf_dir, "vector_cache")
    key = cache.agg(F.min("cache_key")).first()[0]
    return cache.where(F.col("cache_key") == key).select("cache_key", "dim")


@add("tag_scan", "SELECT DISTINCT memory_id FROM memory_points WHERE list_contains(tags, 'system:high_priority_distillation')")
def tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory that carries the queue's tag."""
    return table(spark, sf_dir, "memory_points").where(S.queued(F.col("tags"))).select("memory_id").distinct()


@add(
    "collection_info",
    "SELECT collection, count(*)::bigint AS n_rows, count(DISTINCT memory_id)::bigint AS n_memories, coalesce(max(len(vector)), 0)::int AS dim FROM memory_points GROUP BY collection",
)
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.max(F.when(F.col("vector").isNotNull(), F.size("vector"))), F.lit(0))
    return table(spark, sf_dir, "memory_points").groupBy("collection").agg(F.count("*").alias("n_rows"), F.countDistinct("memory_id").alias("n_memories"), size.alias("dim"))


@add(
    "ingest_batch",
    f"""SELECT unit_id, text AS text_content, coalesce(unit_ts, {NOW}e0) AS recency_ts, coalesce(unit_ts, {NOW}e0) AS created_ts, 0.5e0 AS predictive, 0 AS success_count, 0 AS failure_count,
      0e0 AS utility, 0 AS frequency, false AS is_compressed, 0 AS version, coalesce(source, '') AS source FROM memory_units""",
)
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as new memories: defaults filled in, a missing time is now."""
    units = table(spark, sf_dir, "memory_units").select("unit_id", F.col("text").alias("text_content"), F.col("unit_ts").alias("recency_ts"), "source")
    return memory.ingest(units, NOW).drop("tags")


@add("delete_antijoin", f"WITH {COMP} SELECT memory_id FROM scored WHERE NOT s <= 0.3e0")
def delete_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories left after those of the lowest tier are deleted."""
    all_ = scored(spark, sf_dir).select("memory_id", "s")
    return memory.delete(all_, all_.where("s <= 0.3")).select("memory_id")


@add("distinct_sources", "SELECT DISTINCT lower(trim(source)) AS source FROM memory_points WHERE trim(source) <> ''")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers, in one spelling."""
    source = F.lower(F.trim("source"))
    return table(spark, sf_dir, "memory_points").where(source != "").select(source.alias("source")).distinct()


@add(
    "complete_dialogues",
    """SELECT dialogue FROM (SELECT dialogue, unnest(sessions) AS s FROM fact_clusters) WHERE dialogue IS NOT NULL AND s IN (1, 2, 3) GROUP BY dialogue HAVING count(DISTINCT s) = 3""",
)
def complete_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues with facts in every one of the sessions 1 to 3 (relational division)."""
    s = table(spark, sf_dir, "fact_clusters").where("dialogue IS NOT NULL").select("dialogue", F.explode("sessions").alias("s")).where("s IN (1, 2, 3)")
    return s.groupBy("dialogue").agg(F.countDistinct("s").alias("n")).where("n = 3").select("dialogue")


@add(
    "metadata_report",
    """SELECT kind, count(*)::bigint AS n, min(n_tokens) AS low, max(n_tokens) AS high, round(avg(n_tokens), 6) AS mean, round(quantile_cont(n_tokens, 0.5), 6) AS median FROM documents GROUP BY kind""",
)
def metadata_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("kind").agg(
        F.count("*").alias("n"), F.min("n_tokens").alias("low"), F.max("n_tokens").alias("high"),
        F.round(F.avg("n_tokens"), 6).alias("mean"), F.round(F.percentile("n_tokens", 0.5), 6).alias("median"),
    )


def _cache_key(text):
    return F.sha2(F.concat(F.lit("hash-64\0"), text), 256)


@add(
    "embed_cache_misses",
    """SELECT DISTINCT sha256('hash-64' || chr(0) || text) AS key FROM memory_units WHERE text IS NOT NULL AND trim(text) <> '' AND sha256('hash-64' || chr(0) || text) NOT IN (SELECT cache_key FROM vector_cache WHERE cache_key IS NOT NULL)""",
)
def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of texts that the vector cache lacks."""
    texts = table(spark, sf_dir, "memory_units").where("text IS NOT NULL AND trim(text) <> ''").select(_cache_key(F.col("text")).alias("key")).distinct()
    return texts.join(table(spark, sf_dir, "vector_cache").select(F.col("cache_key").alias("key")), "key", "left_anti")


_DONE_KEY = "sha256(coalesce(source, '') || ':' || coalesce(context_index, -1))"


@add(
    "resume_antijoin",
    f"""WITH k AS (SELECT context_id, {_DONE_KEY} AS key, questions FROM contexts), done AS (SELECT key FROM k WHERE len(questions) > 0)
    SELECT context_id, key FROM k WHERE key NOT IN (SELECT key FROM done)""",
)
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts whose content key isn't among the finished ones, here those whose questions were asked."""
    key = F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce("context_index", F.lit(-1)).cast("string")), 256)
    keyed = table(spark, sf_dir, "contexts").select("context_id", key.alias("key"), "questions")
    done = keyed.where(F.size("questions") > 0).select("key")
    return keyed.select("context_id", "key").join(done, "key", "left_anti").select("context_id", "key")


@add(
    "pending_requests",
    """WITH k AS (SELECT lower(trim(custom_id)) AS key, batch_id FROM collected_requests WHERE trim(custom_id) <> '')
    SELECT key, count(*)::bigint AS asked FROM k WHERE key NOT IN (SELECT key FROM k WHERE batch_id = 'batch_0061') GROUP BY key""",
)
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests still to send: one per key, those answered in a given batch left out."""
    r = table(spark, sf_dir, "collected_requests").select(F.lower(F.trim("custom_id")).alias("key"), "batch_id").where("key <> ''")
    done = r.where("batch_id = 'batch_0061'").select("key").distinct()
    return r.join(done, "key", "left_anti").groupBy("key").agg(F.count("*").alias("asked"))


#: Limits of a batch.
MAX_REQUESTS, MAX_TOKENS = 50, 8000


@add("pack_batches")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each batch file packed in line order under 50 requests and 8,000 tokens a batch.

    Order matters, so each file is one fold, a stream of its sorted lines that holds the open batch's counters only; its
    lines carry only numbers.
    """
    tokens = (F.length(F.coalesce("body", F.lit(""))) / 3).cast("long") + 4
    return packed(table(spark, sf_dir, "collected_requests").select("batch_id", "line_no", tokens.alias("tokens")))


def packed(lines: DataFrame) -> DataFrame:
    """(batch_id, line_no, part) of lines (batch_id, line_no, tokens): part is the batch within the file, from 0."""
    kind = lines.schema["line_no"].dataType.simpleString()

    def run(batches):
        file, part, n, used = run, 0, 0, 0  # no file is called `run`
        for batch in batches:
            parts = []
            for name, t in zip(batch.column("batch_id").to_pylist(), batch.column("tokens").to_pylist()):
                if name != file:
                    file, part, n, used = name, 0, 0, 0
                elif n and (n >= MAX_REQUESTS or used + t > MAX_TOKENS):
                    part, n, used = part + 1, 0, 0
                n, used = n + 1, used + t
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column("batch_id"), batch.column("line_no"), pa.array(parts, pa.int64())], ["batch_id", "line_no", "part"])

    return lines.repartition("batch_id").sortWithinPartitions("batch_id", "line_no", "tokens").mapInArrow(run, f"batch_id string, line_no {kind}, part long")


@add(
    "patch_merge",
    f"WITH {MEM} SELECT memory_id, CASE WHEN frequency >= 100 THEN 100 ELSE frequency END::bigint AS frequency, coalesce(version, 0) + CASE WHEN frequency >= 100 THEN 1 ELSE 0 END AS version FROM mem",
)
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unguarded patch: frequencies over 100 set to 100."""
    m = memories(spark, sf_dir).select("memory_id", "frequency", "version")
    return memory.patch(m, m.where("frequency >= 100").select("memory_id", F.lit(100).cast("long").alias("frequency")), ["frequency"])


@add(
    "conditional_patch",
    f"WITH {MEM} SELECT memory_id, frequency + CASE WHEN coalesce(version, 0) = 1 THEN 1 ELSE 0 END AS frequency, coalesce(version, 0) + CASE WHEN coalesce(version, 0) = 1 THEN 1 ELSE 0 END AS version FROM mem",
)
def conditional_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of every memory that holds only at version 1."""
    m = memories(spark, sf_dir).select("memory_id", "frequency", "version")
    updates = m.select("memory_id", (F.col("frequency") + 1).alias("frequency"), F.lit(1).alias("expected_version"))
    return memory.conditional_patch(m, updates, ["frequency"])[0]


@add("patch_conflicts", f"WITH {MEM} SELECT memory_id, coalesce(version, 0)::bigint AS found_version FROM mem WHERE coalesce(version, 0) <> 1")
def patch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates that the guarded patch turns down."""
    m = memories(spark, sf_dir).select("memory_id", "frequency", "version")
    updates = m.select("memory_id", (F.col("frequency") + 1).alias("frequency"), F.lit(1).alias("expected_version"))
    return memory.conditional_patch(m, updates, ["frequency"])[1].select("memory_id", "found_version")


EVENTS = """ev AS (SELECT event_id % (SELECT count(*) FROM embeddings) AS key, event_type, epoch_us(ts) / 1e6 AS t FROM events),
  counts AS (SELECT key, count(*) FILTER (WHERE event_type = 'purchase')::bigint AS success_count, count(*) FILTER (WHERE event_type = 'error')::bigint AS failure_count,
    count(*) FILTER (WHERE event_type IN ('view', 'click'))::bigint AS frequency, max(t) AS recency_ts, min(t) AS created_ts FROM ev WHERE event_type IN ('purchase', 'error', 'view', 'click') GROUP BY key)"""


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return memory.fold(table(spark, sf_dir, "events"), F.col("event_id") % n, F.col("event_type"), at, "purchase", "error", ["view", "click"])


@add("apply_events", f"WITH {EVENTS} SELECT vec_id, coalesce(success_count, 0) AS success_count, coalesce(failure_count, 0) AS failure_count, coalesce(frequency, 0) AS frequency, recency_ts FROM embeddings LEFT JOIN counts ON key = vec_id")
def apply_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded into the counters of their memories, here embeddings that start without any."""
    start = table(spark, sf_dir, "embeddings").select("vec_id", *(F.lit(0).cast("long").alias(c) for c in ("success_count", "failure_count", "frequency")), F.lit(None).cast("double").alias("recency_ts"))
    return memory.apply_fold(start, event_counts(spark, sf_dir), "vec_id")


@add(
    "apply_feedback",
    f"""WITH {COMP}, shown AS (SELECT memory_id, CASE WHEN s > 0.55e0 THEN 'YES' WHEN s < 0.35e0 THEN 'NO' ELSE 'NEUTRAL' END AS verdict FROM scored)
    SELECT m.memory_id, success_count + (verdict = 'YES')::int AS success_count, failure_count + (verdict = 'NO')::int AS failure_count, frequency + (verdict <> 'NEUTRAL')::int AS frequency,
      coalesce(version, 0) + CASE WHEN verdict <> 'NEUTRAL' THEN 2 ELSE 0 END AS version FROM mem m JOIN shown USING (memory_id)""",
)
def apply_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts applied to the memories that were shown; a neutral one writes nothing, another writes two guarded fields."""
    m = scored(spark, sf_dir)
    verdict = F.when(F.col("s") > 0.55, "YES").when(F.col("s") < 0.35, "NO").otherwise("NEUTRAL")
    m = m.withColumn("v", verdict)
    plus = lambda c: F.when(c, 1).otherwise(0)
    said = F.col("v") != "NEUTRAL"
    return m.select(
        "memory_id", (F.col("success_count") + plus(F.col("v") == "YES")).alias("success_count"), (F.col("failure_count") + plus(F.col("v") == "NO")).alias("failure_count"),
        (F.col("frequency") + plus(said)).alias("frequency"), (F.coalesce("version", F.lit(0)) + 2 * plus(said)).alias("version"),
    )


@add(
    "ingest_dedup",
    """SELECT text, min(unit_id)::bigint AS first_unit, count(*)::bigint AS frequency, max(unit_ts) AS recency_ts FROM memory_units WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY text""",
)
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text met again raises the first one's frequency and recency instead of being stored again."""
    u = table(spark, sf_dir, "memory_units").where("text IS NOT NULL AND trim(text) <> ''")
    return u.groupBy("text").agg(F.min("unit_id").alias("first_unit"), F.count("*").alias("frequency"), F.max("unit_ts").alias("recency_ts"))


#: A store of this many memories or fewer isn't maintained (fixed value), and memories taken from the queue at once.
MAINTAIN_OVER, QUEUE_LIMIT = 1000, 100


@add(
    "maintenance_plan",
    f"""WITH {COMP}, n AS (SELECT count(*) AS n FROM mem) SELECT memory_id, CASE WHEN n <= {MAINTAIN_OVER} THEN 'none' ELSE {ACTION_SQL} END AS action FROM scored, n""",
)
def maintenance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action a memory; nothing happens while the store holds 1,000 memories or fewer."""
    n = memories(spark, sf_dir).agg(F.count("*").alias("n"))
    return scored(spark, sf_dir).crossJoin(F.broadcast(n)).select("memory_id", F.when(F.col("n") <= MAINTAIN_OVER, "none").otherwise(action()).alias("action"))


@add(
    "maintenance_cycle",
    f"""WITH {COMP}, n AS (SELECT count(*) AS n FROM mem), a AS (SELECT *, CASE WHEN n <= {MAINTAIN_OVER} THEN 'none' ELSE {ACTION_SQL} END AS action FROM scored, n),
    b AS (SELECT *, action = 'compress' AND NOT coalesce(is_compressed, false) AS pressed FROM a WHERE action <> 'delete')
    SELECT memory_id, CASE WHEN pressed THEN left(text_content, 60) ELSE text_content END AS text_content, CASE WHEN pressed THEN text_content ELSE original_text_backup END AS original_text_backup,
      pressed OR coalesce(is_compressed, false) AS is_compressed, CASE WHEN action = 'compress' THEN list_filter(tags, lambda t: t <> '{S.QUEUE_TAG}') ELSE tags END AS tags,
      CASE WHEN action = 'retain' THEN {NOW}e0 ELSE last_triage_ts END AS last_triage_ts, coalesce(version, 0) + (action IN ('retain', 'compress'))::int AS version FROM b""",
)
def maintenance_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the plan was applied: deleted rows gone, kept ones stamped, compressed ones with their text
    replaced (here by its beginning), the original kept and the queue tag taken off; one pass, no join."""
    n = memories(spark, sf_dir).agg(F.count("*").alias("n"))
    m = scored(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("action", F.when(F.col("n") <= MAINTAIN_OVER, "none").otherwise(action())).where("action <> 'delete'")
    done = F.coalesce("is_compressed", F.lit(False))
    pressed, compress = (F.col("action") == "compress") & ~done, F.col("action") == "compress"
    return m.select(
        "memory_id", F.when(pressed, F.substring("text_content", 1, 60)).otherwise(F.col("text_content")).alias("text_content"),
        F.when(pressed, F.col("text_content")).otherwise(F.col("original_text_backup")).alias("original_text_backup"), (pressed | done).alias("is_compressed"),
        F.when(compress, F.array_remove("tags", S.QUEUE_TAG)).otherwise(F.col("tags")).alias("tags"),
        F.when(F.col("action") == "retain", F.lit(NOW)).otherwise(F.col("last_triage_ts")).alias("last_triage_ts"),
        (F.coalesce("version", F.lit(0)) + F.when(F.col("action").isin("retain", "compress"), 1).otherwise(0)).alias("version"),
    )


@add(
    "distillation_queue",
    f"""WITH {MEM} SELECT memory_id, text_content FROM mem WHERE list_contains(tags, '{S.QUEUE_TAG}') ORDER BY created_ts NULLS FIRST, memory_id LIMIT {QUEUE_LIMIT}""",
)
def distillation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that the next cycle compresses first: at most 100 of those that carry the tag, oldest first (the queue's own limit)."""
    return memories(spark, sf_dir).where(S.queued(F.col("tags"))).orderBy(F.col("created_ts").asc_nulls_first(), "memory_id").limit(QUEUE_LIMIT).select("memory_id", "text_content")


@add("time_jump", f"WITH {MEM} SELECT memory_id, recency_ts - 86400e0 AS recency_ts FROM mem")
def time_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every access moved a day back, as if the clock had jumped."""
    return memories(spark, sf_dir).select("memory_id", (F.col("recency_ts") - 86400.0).alias("recency_ts"))


@add(
    "compress_patch",
    f"""WITH {MEM} SELECT memory_id, left(text_content, 60) AS text_content, text_content AS original_text_backup, true AS is_compressed, list_filter(tags, lambda t: t <> 'system:high_priority_distillation') AS tags, coalesce(version, 0) + 1 AS version
    FROM mem WHERE NOT coalesce(is_compressed, false) AND length(text_content) > 200""",
)
def compress_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts replaced by a summary (here their beginning), the original kept, the queue tag taken off, the vector untouched."""
    return compressed(memories(spark, sf_dir)).select("memory_id", "text_content", "original_text_backup", "is_compressed", "tags", "version")


def compressed(m: DataFrame) -> DataFrame:
    """The long uncompressed memories of `m` after compression, with all their columns."""
    m = m.where(~F.coalesce("is_compressed", F.lit(False)) & (F.length("text_content") > 200))
    return m.withColumns(
        {
            "original_text_backup": F.col("text_content"), "text_content": F.substring("text_content", 1, 60), "is_compressed": F.lit(True),
            "tags": F.array_remove("tags", S.QUEUE_TAG), "version": F.coalesce("version", F.lit(0)) + 1,
        }
    )
