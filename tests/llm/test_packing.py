import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import packing as P


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 400, 3000)
    place = P.best_fit(sizes, 1000, 6, 500_000.0, (1.0, 0.5, 0.5))
    for container in range(place.max() + 1):
        own = sizes[place == container]
        assert 0 < len(own) <= 6 and own.sum() <= 1000 and (own.astype(float) ** 2).sum() <= 500_000
    assert (place >= 0).all()


def test_tight_packing():
    sizes = np.random.default_rng(5).integers(20, 700, 8000)
    n = P.best_fit(sizes, 1024, 1024, 1024.0**2, (1.0, 0.0, 0.0)).max() + 1
    assert n <= np.ceil(sizes.sum() / 1024) * 1.01 + 1


def test_every_item_whole_and_once(spark):
    rows = [(i, s) for i, s in enumerate([0, None, -3, 5, 1024, 1025, 2048, 5000, 700, 324, 324])] + [(99, 10), (99, 10), (None, 7)]
    df = spark.createDataFrame(rows, "container_id int, n long")
    got = P.pack_containers(df, F.col("container_id"), F.col("n")).collect()
    used = {}
    for r in got:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 1024
    sizes = {}
    for r in got:
        sizes.setdefault(r["item_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
    assert sorted(sizes[7]) == [(0, 0, 1024), (1, 1024, 1024), (2, 2048, 1024), (3, 3072, 1024), (4, 4096, 904)]
    assert sorted(sizes[6]) == [(0, 0, 1024), (1, 1024, 1024)] and sizes[1] == [(0, 0, 0)] and len(sizes[99]) == 2 and sizes[None] == [(0, 0, 7)]
    assert P.pack_containers(df.limit(0), F.col("container_id"), F.col("n")).count() == 0


def test_a_container_must_hold_a_document(spark):
    with pytest.raises(ValueError):
        P.pack_containers(spark.range(1), F.col("id"), F.col("id"), docs=0)


def test_binding_limits_and_leftovers(spark, monkeypatch):
    """Groups of 50 leave part-filled containers, which the second step fills; every limit holds."""
    monkeypatch.setattr(P, "GROUP_ROWS", 50)
    rng = np.random.default_rng(6)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(1, 1500, 900))]
    df = spark.createDataFrame(sizes, "id long, n long").repartition(6)
    got = P.pack_containers(df, F.col("id"), F.col("n"), 1024, 3, 400_000.0, (1.0, 0.5, 0.5), group_rows=50).collect()
    containers, items = {}, {}
    for r in got:
        containers.setdefault(r["container_id"], []).append(r["n_tokens"])
        items[r["item_id"]] = items.get(r["item_id"], 0) + r["n_tokens"]
    assert items == dict(sizes)
    for own in containers.values():
        assert sum(own) <= 1024 and len(own) <= 3 and (len(own) == 1 or sum(min(n * n, 400_000.0) for n in own) <= 400_000.0)
    plain = P.pack_containers(df, F.col("id"), F.col("n"), 1024, group_rows=50).collect()
    n_containers = len({r["container_id"] for r in plain})
    assert n_containers <= np.ceil(sum(n for _, n in sizes) / 1024) * 1.06
