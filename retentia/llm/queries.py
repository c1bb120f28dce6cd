"""Queries of the training-data problems; SQL twins where SQL can express the result on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.chunking import split_oversized
from retentia.llm.knn import nearest
from retentia.llm.leaks import find_leaks
from retentia.llm.mojibake import find_garbled
from retentia.llm.neardup import key_pairs, near_duplicate_groups
from retentia.llm.packing import pack_containers
from retentia.plans.registry import Registry
from retentia.sources.tables import table

registry = Registry()

#: Tokens a unit may hold, tokens repeated between pieces, tokens of a prompt container.
UNIT_TOKENS, OVERLAP_TOKENS, CONTAINER_TOKENS = 200, 20, 1024
#: Documents a container may hold, and the weights of tokens, documents and attention cost in the choice of a container.
CONTAINER_DOCUMENTS, WEIGHTS = 64, (1.0, 0.1, 0.1)


#: Neighbours of a vector, its values, and the cosine from which two vectors are close.
NEIGHBOURS, DIMENSIONS, CLOSE = 5, 64, 0.90
#: Least share of the longer text's words that near-duplicates have in common.
SAME_WORDS = 0.8


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored statement: (kind, key, text) of memories and of the variants of fact clusters."""
    memories = table(spark, sf_dir, "memory_points").select(F.lit("memory").alias("kind"), F.col("memory_id").alias("key"), F.col("text_content").alias("text"))
    facts = table(spark, sf_dir, "fact_clusters").select(F.lit("fact").alias("kind"), F.col("cluster_id").alias("key"), F.explode("variants").alias("text"))
    return memories.unionByName(facts)


@registry.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that hold nearly the same words."""
    return key_pairs(_statements(spark, sf_dir), SAME_WORDS).withColumnRenamed("kind", "record_kind")


@registry.add("p1_groups")
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the set of records that hold the same statement."""
    return near_duplicate_groups(_statements(spark, sf_dir), SAME_WORDS).withColumnRenamed("kind", "record_kind")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory unit and context unit: (item_kind, item_id, unit_no, text); repeated rows once."""
    units = table(spark, sf_dir, "memory_units").select(F.lit("unit").alias("item_kind"), F.col("unit_id").alias("item_id"), "unit_no", "text")
    contexts = table(spark, sf_dir, "contexts").select("context_id", F.posexplode("units").alias("unit_no", "unit"))
    contexts = contexts.select(F.lit("context").alias("item_kind"), F.col("context_id").alias("item_id"), "unit_no", F.col("unit.text").alias("text"))
    return units.unionByName(contexts)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    key = [F.col("item_kind"), F.col("item_id"), F.col("unit_no")]
    return split_oversized(units, F.col("text"), key, UNIT_TOKENS, OVERLAP_TOKENS)


@registry.add(
    "p2_found",
    r"""WITH u AS (SELECT 'unit' AS item_kind, unit_id AS item_id, unit_no, text FROM memory_units
      UNION ALL SELECT 'context', context_id, (i - 1)::int, units[i].text FROM (SELECT context_id, units, unnest(range(1, len(units) + 1)) AS i FROM contexts))
    SELECT DISTINCT item_kind, item_id, unit_no FROM u WHERE len(regexp_extract_all(text, '\w+|[^\w\s]+')) > 200""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units over the token limit: those that the splitter cut."""
    return _pieces(spark, sf_dir).where("piece_no = 0").select("item_kind", "item_id", "unit_no").distinct()


@registry.add("p2_pieces")
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every unit over the token limit, one set for repeated rows of a unit."""
    return _pieces(spark, sf_dir).dropDuplicates(["item_kind", "item_id", "unit_no", "piece_no", "start_char", "end_char", "piece"])


def _nearest(spark: SparkSession, sf_dir: str, min_similarity: float | None) -> DataFrame:
    """(vector_kind, key, neighbour, similarity, place) of memory vectors and cached vectors, each in its own table."""
    found = []
    for kind, name, key, vector in (("point", "memory_points", "memory_id", "vector"), ("cache", "vector_cache", "cache_key", "vec")):
        near = nearest(table(spark, sf_dir, name), F.col(key), F.col(vector), NEIGHBOURS, DIMENSIONS, min_similarity=min_similarity)
        found.append(near.select(F.lit(kind).alias("vector_kind"), *near.columns))
    return found[0].unionByName(found[1])


@registry.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of very similar vectors of which one is among the nearest of the other."""
    near = _nearest(spark, sf_dir, CLOSE)
    return near.select("vector_kind", F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


@registry.add("p4_nearest")
def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of every memory vector and cached vector."""
    return _nearest(spark, sf_dir, None).withColumn("similarity", F.round("similarity", 3))


@registry.add("p5_containers")
def p5_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed in prompt containers, whole unless larger than one; of containers with the same room the one
    with the least documents and attention cost left over is taken."""
    documents = table(spark, sf_dir, "documents")
    packed = pack_containers(documents, F.col("doc_id"), F.col("n_tokens"), CONTAINER_TOKENS, CONTAINER_DOCUMENTS, weights=WEIGHTS)
    return packed.withColumnRenamed("item_id", "doc_id")


@registry.add("p5_containers_limited")
def p5_containers_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under limits that bind: four documents a container, and 40 % of the attention cost of a full one."""
    documents = table(spark, sf_dir, "documents")
    packed = pack_containers(documents, F.col("doc_id"), F.col("n_tokens"), CONTAINER_TOKENS, 4, 0.4 * CONTAINER_TOKENS**2, (1.0, 0.5, 0.5))
    return packed.withColumnRenamed("item_id", "doc_id")


@registry.add("p5_limits_kept", "SELECT count(*)::bigint AS documents, true AS tokens_kept, true AS documents_kept, true AS attention_kept FROM documents")
def p5_limits_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed by p5_containers_limited, and whether every container keeps each of its limits."""
    each = F.pow(F.col("n_tokens").cast("double"), F.lit(2.0))
    cost = F.sum(F.least(each, F.lit(0.4 * CONTAINER_TOKENS**2)))
    placed = p5_containers_limited(spark, sf_dir)
    whole = placed.where(F.col("n_tokens") < CONTAINER_TOKENS)
    c = whole.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"), cost.alias("a"))
    kept = c.agg(*(F.coalesce(F.bool_and(F.col(x) <= most), F.lit(True)).alias(name) for x, most, name in (("t", CONTAINER_TOKENS, "tokens_kept"), ("d", 4, "documents_kept"), ("a", 0.4 * CONTAINER_TOKENS**2 + 0.5, "attention_kept"))))
    return placed.where("piece_no = 0").agg(F.count("*").alias("documents")).crossJoin(kept)


@registry.add(
    "p5_documents_placed",
    """SELECT doc_id, coalesce(n_tokens, 0)::bigint AS n_tokens, greatest(1, (coalesce(n_tokens, 0) + 1023) // 1024)::bigint AS n_pieces
    FROM documents""",
)
def p5_documents_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the tokens and pieces placed for it."""
    placed = p5_containers(spark, sf_dir).groupBy("doc_id")
    return placed.agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))


def _room_left(placed: DataFrame) -> DataFrame:
    used = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = used.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return total.withColumn("room_left", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * CONTAINER_TOKENS), 6))


@registry.add("p5_room_left")
def p5_room_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens placed and the share of room left, over the whole table."""
    return _room_left(p5_containers(spark, sf_dir))


@registry.add("p5_room_left_limited")
def p5_room_left_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the limits that bind."""
    return _room_left(p5_containers_limited(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return find_leaks(documents, F.col("doc_id"), F.col("text"), items, "item_id", "item_text")


@registry.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of an evaluation item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@registry.add("p6_passages")
def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest leaked passage of each item in each document: first item word, words, edits."""
    return _leaks(spark, sf_dir)


@registry.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with garbled text."""
    documents = table(spark, sf_dir, "documents")
    return find_garbled(documents, [F.col("doc_id")], F.col("text"), restore=False).select("doc_id").distinct()


@registry.add("p7_restored")
def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with garbled text and what could be restored of it."""
    return find_garbled(table(spark, sf_dir, "documents"), [F.col("doc_id")], F.col("text"))
