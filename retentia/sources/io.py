"""JSON lines, collections as partitioned parquet, caches and checksums."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payload of a stored memory; unknown keys of a JSON line go to `extra`.
_TYPES = {
    T.StringType(): "memory_id collection text_content source",
    T.LongType(): "success_count failure_count frequency version",
    T.DoubleType(): "utility recency_ts predictive created_ts",
    T.BooleanType(): "is_compressed",
    T.ArrayType(T.FloatType()): "vector",
    T.ArrayType(T.StringType()): "tags",
}
MEMORY = T.StructType([T.StructField(name, kind) for kind, names in _TYPES.items() for name in names.split()])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, split: str | None = None) -> DataFrame:
    """Typed JSON lines; blank and broken lines are left out, `split` filters on the column of that name."""
    kept = T.StructType([*schema.fields, T.StructField("__broken", T.StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__broken").json(path)
    rows = rows.where(F.col("__broken").isNull()).drop("__broken")
    return rows if split is None else rows.where(F.col("split") == split)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Memories from JSON lines of any keys: known ones typed with defaults, the others in `extra`."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = F.from_json("value", MEMORY)
    every = F.from_json("value", "map<string,string>")
    rows = lines.select(known.alias("m"), F.map_filter(every, lambda k, _: ~k.isin(MEMORY.names)).alias("extra")).where(F.col("m").isNotNull())
    rows = rows.select("m.*", "extra")
    zero = {c: 0 for c in ("success_count", "failure_count", "frequency", "version")} | {"utility": 0.0, "predictive": 0.5, "is_compressed": False, "source": ""}
    return rows.fillna(zero)


def write_jsonl(df: DataFrame, path: str, **facts: object) -> None:
    """JSON lines in `path`/rows and a one-line manifest of the run in `path`/manifest."""
    df.write.mode("overwrite").json(f"{path}/rows")
    manifest = json.dumps({"columns": df.columns} | facts, sort_keys=True, default=str)
    df.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def write_collection(memories: DataFrame, path: str) -> None:
    """All collections as parquet, one folder each; ids stay sorted in a file, so a lookup skips row groups."""
    memories.sortWithinPartitions("collection", "memory_id").write.mode("overwrite").partitionBy("collection").parquet(path)


def replace_collection(spark: SparkSession, path: str, name: str, rows: DataFrame | None) -> None:
    """Copy on write of one collection: only its folder is replaced, or dropped with None. `rows` must not read `path`."""
    kept = spark.read.parquet(path).where(F.col("collection") == name).limit(0) if rows is None else rows.where(F.col("collection") == name)
    previous = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    if rows is None:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/collection={name}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        kept.write.mode("overwrite").partitionBy("collection").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", previous)


def cache_key(text: Column, namespace: str) -> Column:
    """Content address of a text under a model's namespace."""
    return F.sha2(F.concat(F.lit(f"{namespace}\0"), text), 256)


def cache_misses(texts: DataFrame, text: str, cache: DataFrame, namespace: str, key: str = "cache_key") -> DataFrame:
    """(key, text) of the different texts that the cache lacks."""
    wanted = texts.where(F.col(text).isNotNull()).select(cache_key(F.col(text), namespace).alias(key), F.col(text)).dropDuplicates([key])
    return wanted.join(cache.select(key), key, "left_anti")


def put_if_absent(cache: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The cache with the rows whose key it lacks, one a key; what is stored is never replaced. Null keys are left out."""
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    return cache.unionByName(new.select(cache.columns))


def request_key(body: Column) -> Column:
    """Content address of a request: its JSON with keys in order, so that their order and spacing play no part; null
    where it isn't JSON."""
    return F.sha2(F.to_json(F.try_parse_json(body)), 256)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes `df` beside `path` and puts it in its place by renaming, so a reader sees the old rows or the new ones."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    files = target.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    files.delete(old, True)
    if files.exists(target):
        files.rename(target, old)
    files.rename(fresh, target)
    files.delete(old, True)


def append_audit(df: DataFrame, path: str) -> None:
    """Rows added to an audit log of JSON lines."""
    df.write.mode("append").json(path)


def read_dataset(spark: SparkSession, path: str, lists: list[str], source: str | None = None) -> DataFrame:
    """JSON lines of a dataset whose `lists` columns hold a string or a list of strings: (source, *lists), always lists.

    The source stands in `metadata.source`; rows of other sources are left out where one is given.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value")).where(F.col("v").isNotNull())
    name = F.expr("try_variant_get(v, '$.metadata.source', 'string')")
    as_list = lambda c: F.coalesce(F.expr(f"try_variant_get(v, '$.{c}', 'array<string>')"), F.when(F.expr(f"try_variant_get(v, '$.{c}', 'string')").isNotNull(), F.array(F.expr(f"try_variant_get(v, '$.{c}', 'string')"))))
    rows = lines.select(name.alias("source"), *(as_list(c).alias(c) for c in lists))
    return rows if source is None else rows.where(F.col("source") == source)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))
