import numpy as np
from pyspark.sql import functions as F

from retentia.llm import knn as K


def brute(keys, vectors, k):
    u = np.array(vectors, dtype=float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {key: {keys[j] for j in np.argsort(-row)[:k]} for key, row in zip(keys, s)}


def near(df, **options):
    got = {}
    for r in K.nearest(df, F.col("key"), F.col("v"), dim=16, **options).collect():
        got.setdefault(r["key"], {})[r["place"]] = r["neighbour"]
    return got


def cloud(n=900, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 16))
    return [f"k{i}" for i in range(n)], (centres[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, 16))).tolist()


def test_recall_against_brute_force(spark):
    keys, vectors = cloud()
    df = spark.createDataFrame(list(zip(keys, vectors)), "key string, v array<double>").repartition(4)
    want = brute(keys, vectors, 5)
    for options in ({"probes": 12}, {"probes": 12, "group_rows": 100, "query_rows": 150}):
        got = near(df, **options)
        hits = sum(len(set(got[k].values()) & want[k]) for k in keys)
        assert hits >= 0.95 * 5 * len(keys)
        assert all(sorted(g) == list(range(5)) for g in got.values())


def test_edges(spark):
    v = [1.0] + [0.0] * 15
    rows = [("a", v), ("b", [2 * x for x in v]), ("c", None), ("d", [0.0] * 16), ("e", [1.0]), (None, v), ("f", [float("nan")] * 16), ("g", v[::-1]), ("a", v), ("h", [None] * 16)]
    got = near(spark.createDataFrame(rows, "key string, v array<double>"))
    assert got["a"] == {0: "b", 1: "g"} and got["b"] == {0: "a", 1: "g"} and set(got["g"].values()) == {"a", "b"} and set(got) == {"a", "b", "g"}
    empty = spark.createDataFrame([], "key string, v array<double>")
    assert near(empty) == {}


def test_hot_group_of_copies(spark):
    keys, vectors = cloud(200)
    rows = list(zip(keys, vectors)) + [(f"copy{i:03}", vectors[0]) for i in range(100)]
    got = near(spark.createDataFrame(rows, "key string, v array<double>"), probes=20)
    assert got["copy050"] == {i: f"copy{i:03}" for i in range(5)} and got["copy000"] == {i: f"copy{i + 1:03}" for i in range(5)}
    assert len(got) == 300


def test_threshold_only_drops(spark):
    keys, vectors = cloud(300)
    df = spark.createDataFrame(list(zip(keys, vectors)), "key string, v array<double>")
    all_ = {(r["key"], r["neighbour"]) for r in K.nearest(df, F.col("key"), F.col("v"), dim=16).where("similarity >= 0.9").collect()}
    some = {(r["key"], r["neighbour"]) for r in K.nearest(df, F.col("key"), F.col("v"), dim=16, min_similarity=0.9).collect()}
    assert some == all_ and some


def test_partition_names_match_spark(spark):
    names = K.partition_names(7)
    df = spark.createDataFrame([(int(x),) for x in names], "slot int").repartition(7, "slot").select("slot", F.spark_partition_id().alias("p"))
    assert {r["slot"]: r["p"] for r in df.collect()} == {int(x): i for i, x in enumerate(names)}


def test_similarities_are_those_of_the_vectors(spark):
    """Measured probes; every similarity is the exact one to 0.0001, and recall holds."""
    keys, vectors = cloud(1500, 7)
    df = spark.createDataFrame(list(zip(keys, vectors)), "key string, v array<double>").repartition(5)
    rows = K.nearest(df, F.col("key"), F.col("v"), dim=16).collect()
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in zip(keys, vectors)}
    assert max(abs(r["similarity"] - unit[r["key"]] @ unit[r["neighbour"]]) for r in rows) < 1e-4
    want = brute(keys, vectors, 5)
    assert sum(r["neighbour"] in want[r["key"]] for r in rows) >= 0.95 * 5 * len(keys)


def test_lists_by_way_of_cells():
    """With fewer cells than there are, the nearest lists are still found for nearly all rows."""
    rng = np.random.default_rng(3)
    centroids = rng.normal(size=(3600, 16)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1)[:, None]
    cells = K._kmeans(centroids, 60)
    of = (centroids @ cells.T).argmax(axis=1)
    lists_of = [np.flatnonzero(of == c) for c in range(60)]
    x = centroids[rng.integers(0, 3600, 300)] + 0.1 * rng.normal(size=(300, 16)).astype(np.float32)
    lists, reach = K.nearest_lists(x, centroids, cells, lists_of, 10)
    true = np.argsort(-(x @ centroids.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(lists, true)]) >= 9.3
    assert (np.diff(reach, axis=1) <= 0).all()
