"""The test tables by name, and the memory state derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings memory_points fact_clusters "
    "memory_units contexts collected_requests vector_cache eval_items"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one parquet table; column pruning and filters reach the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
