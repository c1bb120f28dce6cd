"""Memory state: current rows, ingestion, patches, folds of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions import score as S

#: What a new memory starts with.
DEFAULTS = {"success_count": 0, "failure_count": 0, "utility": 0.0, "frequency": 0, "is_compressed": False, "version": 0}


def current(points: DataFrame) -> DataFrame:
    """One row per memory_id, that of the highest version and then the latest arrival; null ids are left out.

    Rows equal in both are told apart by their counters and the hash of their text, so that no run differs from another.
    """
    ties = [c for c in ("frequency", "success_count", "failure_count", "recency_ts") if c in points.columns]
    order = [F.col(c).desc_nulls_last() for c in ("version", "ingested_at", *ties)]
    if "text_content" in points.columns:
        order.append(F.md5("text_content").desc_nulls_last())
    w = Window.partitionBy("memory_id").orderBy(*order)
    kept = points.where(F.col("memory_id").isNotNull()).withColumn("__nth", F.row_number().over(w))
    return kept.where("__nth = 1").drop("__nth")


def with_components(memories: DataFrame, now: float, decay: float = S.DECAY, cap: float = S.FREQUENCY_CAP) -> DataFrame:
    """Adds r, f, u, p; missing counters count as 0, a missing access as the creation, a missing P as 0.5."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return memories.withColumns(
        {
            "r": S.recency(F.coalesce("recency_ts", "created_ts", F.lit(0.0)), now, decay),
            "f": S.frequency(n("frequency"), cap),
            "u": S.utility(n("success_count"), n("failure_count")),
            "p": F.coalesce("predictive", F.lit(0.5)),
        }
    )


def with_score(memories: DataFrame, now: float, weights=S.WEIGHTS) -> DataFrame:
    """Adds the components and s."""
    scored = with_components(memories, now)
    return scored.withColumn("s", S.composite(*(F.col(c) for c in "rfup"), weights))


def ingest(rows: DataFrame, now: float) -> DataFrame:
    """New memories (memory_id, text_content[, recency_ts, predictive, tags, source]) with defaults filled in."""
    have = set(rows.columns)
    value = lambda c, d: F.coalesce(F.col(c), d) if c in have else d
    at = value("recency_ts", F.lit(float(now)))
    columns = {"recency_ts": at, "created_ts": at, "predictive": F.least(F.lit(1.0), F.greatest(F.lit(0.0), value("predictive", F.lit(0.5))))}
    columns |= {c: F.lit(d) for c, d in DEFAULTS.items()} | {"source": value("source", F.lit("")), "tags": value("tags", F.array().cast("array<string>"))}
    return rows.withColumns(columns)


def patch(memories: DataFrame, updates: DataFrame, columns: list[str], key: str = "memory_id") -> DataFrame:
    """`columns` replaced by non-null values of `updates`, version raised where a row was patched."""
    new = updates.select(F.col(key), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = memories.join(new, key, "left")
    out = {c: F.coalesce(f"__{c}", c) for c in columns} | {"version": F.coalesce("version", F.lit(0)) + F.when(F.col("__hit"), 1).otherwise(0)}
    return joined.withColumns(out).drop("__hit", *(f"__{c}" for c in columns))


def conditional_patch(memories: DataFrame, updates: DataFrame, columns: list[str], key: str = "memory_id") -> tuple[DataFrame, DataFrame]:
    """(memories, rejected updates): an update holds only at its `expected_version` (a missing version is 0)."""
    seen = memories.select(key, F.coalesce("version", F.lit(0)).alias("__now"))
    judged = updates.join(seen, key, "left").withColumn("__ok", F.col("__now").eqNullSafe(F.col("expected_version").cast("long")))
    accepted = judged.where("__ok").select(key, *columns)
    rejected = judged.where("NOT __ok").select(*updates.columns, F.col("__now").alias("found_version"))
    return patch(memories, accepted, columns, key), rejected


def delete(memories: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """Memories without those named in `ids`."""
    return memories.join(ids.select(key).distinct(), key, "left_anti")


def fold(events: DataFrame, key: Column, kind: Column, at: Column, success: str, failure: str, access: list[str]) -> DataFrame:
    """Counters of each key: success, failure and access events, and the last time; the order plays no part."""
    rows = events.select(key.alias("key"), kind.alias("kind"), at.alias("at"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return rows.where(F.col("kind").isin(success, failure, *access)).groupBy("key").agg(
        n(F.col("kind") == success)("success_count"), n(F.col("kind") == failure)("failure_count"),
        n(F.col("kind").isin(access))("frequency"), F.max("at").alias("recency_ts"), F.min("at").alias("created_ts"),
    )


def apply_fold(memories: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Counters added to memories in one join; an access never moves recency backwards here."""
    c = counts.select(F.col("key").alias(key), *(F.col(x).alias(f"__{x}") for x in ("success_count", "failure_count", "frequency", "recency_ts")))
    joined = memories.join(c, key, "left")
    add = {x: F.coalesce(x, F.lit(0)) + F.coalesce(f"__{x}", F.lit(0)) for x in ("success_count", "failure_count", "frequency")}
    out = joined.withColumns(add | {"recency_ts": F.greatest("recency_ts", "__recency_ts")})
    return out.drop("__success_count", "__failure_count", "__frequency", "__recency_ts")
