import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.operators import delivery as D

HEX = "ab" * 32


def test_permutation_is_one_to_one():
    rng = np.random.default_rng(1)
    for width in (4, 8, 12):
        words = rng.integers(0, 2**63, (500, width), dtype=np.int64).view(np.uint64)
        assert (D.unpermute(D.permute(words)) == words).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=40))
def test_encoding_is_one_to_one(ids):
    codes = {}
    for rows, words in D.encode_ids(ids):
        for row, w in zip(rows, words):
            codes.setdefault(w.tobytes(), set()).add(ids[row])
    assert all(len(same) == 1 for same in codes.values())
    assert len(codes) == len(set(ids))


def test_table_counts_every_row_and_keeps_the_first():
    words = np.array([[7, 1], [7, 2], [7, 1], [7, 1], [9, 2]], dtype=np.uint64)
    first, n = D._once(words, np.array([1, 1, 2, 1, 1]))
    assert first.tolist() == [0, 1, 4] and n.tolist() == [4, 1, 1]


def test_table_with_only_collisions():
    words = np.stack([np.arange(200, dtype=np.uint64), np.zeros(200, dtype=np.uint64)], axis=1)
    first, n = D._once(np.concatenate([words, words]), np.ones(400, dtype=np.int64))
    assert first.tolist() == list(range(200)) and (n == 2).all()


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (HEX, 2, "b", None), (f"  {HEX.upper()} ", 1, "a", "x"), (HEX, None, None, None), (None, 1, "z", None), ("", 1, "z", None), (" \t ", 1, "z", None),
        ("plain id", 1, "p", None), ("Plain ID", 1, "p", None), ("x" * 5000, 1, "", None), ("Ünï", 3, "u", None),
    ]
    return spark.createDataFrame(data, "custom_id string, shard int, `n.x` string, kept string")


def test_one_row_each(rows):
    got = {r["request_id"]: (r["n_deliveries"], r["kept"]["n.x"], r["kept"]["shard"]) for r in D.once_per_id(rows, "custom_id", [F.col("shard")]).collect()}
    assert got == {HEX: (3, "a", 1), "plain id": (2, "p", 1), "x" * 5000: (1, "", 1), "ünï": (1, "u", 3)}


def test_hot_identifier_over_many_shards(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = D.once_per_id(many, "k", [F.col("id")], shard_rows=100)
    assert got.count() == 2001
    hot = got.where("request_id = 'hot'").first()
    assert hot["n_deliveries"] == 1000 and hot["kept"]["id"] == 0


def test_empty(spark):
    empty = spark.createDataFrame([], "custom_id string, body string")
    assert D.once_per_id(empty, "custom_id").count() == 0
