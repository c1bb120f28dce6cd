import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions import providers
from retentia.sources import io


def test_jsonl_round_trip_and_broken_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "split": "dev", "new": 5}\n\n{"a": "broken\n{"a": 2, "split": "test"}\n')
    schema = T.StructType.fromDDL("a int, split string")
    assert {r["a"] for r in io.read_jsonl(spark, str(path), schema).collect()} == {1, 2}
    assert [r["a"] for r in io.read_jsonl(spark, str(path), schema, "test").collect()] == [2]
    io.write_jsonl(io.read_jsonl(spark, str(path), schema), f"{tmp_path}/out", seed=7)
    assert spark.read.json(f"{tmp_path}/out/rows").count() == 2
    assert '"seed": 7' in spark.read.text(f"{tmp_path}/out/manifest").first()[0]


def test_unknown_keys_are_kept(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"memory_id": "a", "unit_index": 3, "frequency": 4}\n\n{"memory_id": "b"}\n')
    got = {r["memory_id"]: r for r in io.read_memories(spark, f"{tmp_path}/m.jsonl").collect()}
    assert got["a"]["extra"] == {"unit_index": "3"} and got["a"]["frequency"] == 4
    assert got["b"]["predictive"] == 0.5 and got["b"]["version"] == 0 and got["b"]["source"] == ""


def test_collections_are_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/store"
    io.write_collection(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "memory_id string, collection string"), path)
    io.replace_collection(spark, path, "y", spark.createDataFrame([("d", "y")], "memory_id string, collection string"))
    assert {tuple(r) for r in spark.read.parquet(path).select("memory_id", "collection").collect()} == {("a", "x"), ("d", "y")}
    io.replace_collection(spark, path, "y", None)
    assert [r[0] for r in spark.read.parquet(path).select("memory_id").collect()] == ["a"]


def test_cache_and_checksums(spark, tmp_path):
    texts = spark.createDataFrame([("hit",), ("miss",), ("miss",), (None,)], "text string")
    cache = texts.where("text = 'hit'").select(io.cache_key(F.col("text"), "model").alias("cache_key"))
    assert [r["text"] for r in io.cache_misses(texts, "text", cache, "model").collect()] == ["miss"]
    (tmp_path / "f").write_bytes(b"abc")
    assert [r["digest"] for r in io.checksums(spark, str(tmp_path)).collect()] == [hashlib.sha256(b"abc").hexdigest()]


def test_providers(spark):
    df = spark.createDataFrame([("Blue kettle", "kettle blue"), (None, ""), ("x", None)], "a string, b string")
    rows = df.select(providers.hashing_vector(F.col("a"), 32, unit=True).alias("v"), providers.hashing_vector(F.col("b"), 8).alias("w"), providers.lexical_verdict(F.col("a"), F.col("b")).alias("j")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-9 and rows[0]["j"] == "YES" and rows[1]["j"] == "NEUTRAL" and rows[1]["v"] == [0.0] * 32
    lengths = providers.with_encoder(df, "a", lambda: lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [r["vector"] for r in lengths] == [[11.0], None, [1.0]]


def test_caches(spark, tmp_path):
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3), (None, 4)], "k string, v int")
    assert {tuple(r) for r in io.put_if_absent(cache, new, "k").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    bodies = spark.createDataFrame([('{"b": 1, "a": {"d": [1, 2], "c": "x"}}',), ('{"a":{"c":"x","d":[1,2]},"b":1}',), ('{"a": 2, "b": 1}',), ("{broken",), (None,)], "b string")
    keys = [r[0] for r in bodies.select(io.request_key(F.col("b"))).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3:] == [None, None]
    path = f"{tmp_path}/t"
    io.replace_table(cache, path)
    io.replace_table(io.put_if_absent(spark.read.parquet(path), new, "k"), path)
    assert spark.read.parquet(path).count() == 3
    io.append_audit(cache, f"{tmp_path}/log")
    io.append_audit(cache, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4


def test_dataset_lists(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"metadata": {"source": "s"}, "questions": "one", "answers": ["a", "b"]}\n\n{"metadata": {"source": "t"}, "questions": ["x"]}\n{oops\n')
    got = io.read_dataset(spark, f"{tmp_path}/d.jsonl", ["questions", "answers"]).collect()
    assert {(r[0], tuple(r[1]), r[2] and tuple(r[2])) for r in got} == {("s", ("one",), ("a", "b")), ("t", ("x",), None)}
    assert io.read_dataset(spark, f"{tmp_path}/d.jsonl", ["questions"], "t").count() == 1
