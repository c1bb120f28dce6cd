"""Inputs that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators import memory, vector
from retentia.sources.tables import table

#: The moment of every score (2024-03-10 UTC), candidates a query fetches, and every how many ids one is a query.
NOW, FETCH_K, QUERY_EVERY = 1710028800.0, 15, 20

MEM = """mem AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY version DESC NULLS LAST,
  ingested_at DESC NULLS LAST, frequency DESC NULLS LAST, success_count DESC NULLS LAST, failure_count DESC NULLS LAST, recency_ts DESC NULLS LAST,
  md5(text_content) DESC NULLS LAST) AS rn FROM memory_points WHERE memory_id IS NOT NULL) WHERE rn = 1)"""
COMP = f"""{MEM}, comp AS (SELECT *, exp(-0.005e0 * greatest({NOW}e0 - coalesce(recency_ts, created_ts, 0e0), 0e0) / 3600e0) AS r,
  least(ln(1e0 + coalesce(frequency, 0)) / ln(51e0), 1e0) AS f,
  (coalesce(success_count, 0) + 1e0) / (coalesce(success_count, 0) + coalesce(failure_count, 0) + 2e0) AS u, coalesce(predictive, 0.5e0) AS p FROM mem),
  scored AS (SELECT *, round(greatest(0e0, least(1e0, 0.3e0 * r + 0.2e0 * f + 0.3e0 * u + 0.2e0 * p)), 6) AS s FROM comp)"""
CAND = f"""{COMP}, q AS (SELECT vec_id AS qid, embedding::double[] AS qv FROM embeddings WHERE vec_id % 20 = 0 AND len(embedding) = 64),
  sims AS (SELECT qid, memory_id, round(CASE WHEN list_dot_product(vector::double[], vector::double[]) > 0
    THEN list_dot_product(qv, vector::double[]) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(vector::double[], vector::double[]))) ELSE 0e0 END, 6) AS sim
    FROM q, mem WHERE len(vector) = 64),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, memory_id) AS sim_rank FROM sims) WHERE sim_rank <= 15),
  cand AS (SELECT t.*, r, f, u, p, s, text_content, frequency, created_ts, recency_ts, source FROM top t JOIN scored USING (memory_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, sim_rank) AS s_rank FROM cand)"""


def sql_rerank(fused: str, more: str = "") -> str:
    """The CTEs of a reranking: `final` has fused and pos."""
    return f"""{CAND}, fusedc AS (SELECT *, round({fused}, 9) AS fused FROM ranked){more},
    final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, sim_rank) AS pos FROM fusedc)"""


RRF = "1e0 / (60 + sim_rank) + 1e0 / (60 + s_rank)"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.current(table(spark, sf_dir, "memory_points"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.with_score(memories(spark, sf_dir), NOW)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def candidates(spark: SparkSession, sf_dir: str, fetch_k: int = FETCH_K) -> DataFrame:
    """(qid, memory_id, sim, sim_rank) joined with components and score: search first, score what was fetched."""
    all_ = memories(spark, sf_dir)
    found = vector.knn(query_vectors(spark, sf_dir), "qid", "qv", all_, "memory_id", "vector", fetch_k)
    columns = ("memory_id", "r", "f", "u", "p", "s", "text_content", "frequency", "created_ts", "recency_ts", "source")
    return found.join(memory.with_score(all_, NOW).select(*columns), "memory_id")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


TOPIC_SQL = "coalesce(list_filter(list_transform(tags, lambda t: CASE WHEN starts_with(t, 'topic:') THEN substr(t, 7) END), lambda t: t IS NOT NULL)[1], 'unknown')"


def topic():
    """What the first topic tag names, else unknown."""
    named = F.filter("tags", lambda t: t.startswith("topic:"))
    return F.coalesce(F.substring(F.try_element_at(named, F.lit(1)), 7, 1000), F.lit("unknown"))
