from pyspark.sql import functions as F

from retentia.operators import memory, rank, stats, vector


def candidates(spark):
    rows = [(1, i, round(0.9 - 0.05 * i, 2), i + 1, s) for i, s in enumerate((0.2, 0.9, 0.2, 0.5, 0.5))]
    return spark.createDataFrame(rows, "qid long, memory_id long, sim double, sim_rank int, s double")


def order(df):
    return [r["memory_id"] for r in df.orderBy("pos").collect()]


def test_no_weight_on_score_is_similarity(spark):
    c = candidates(spark)
    assert order(rank.rerank(c, "wrrf", beta_sim=1.0, beta_score=0.0)) == order(rank.rerank(c, "similarity")) == [0, 1, 2, 3, 4]


def test_constant_score_keeps_similarity(spark):
    c = candidates(spark).withColumn("s", F.lit(0.5))
    assert order(rank.rerank(c, "rrf")) == [0, 1, 2, 3, 4]


def test_deeper_ranking_has_the_same_prefix(spark):
    c = candidates(spark)
    assert order(rank.rerank(c, "rrf", 2)) == order(rank.rerank(c, "rrf"))[:2]


def test_budget_is_a_prefix(spark):
    ranked = rank.rerank(candidates(spark), "similarity")
    kept = rank.within_budget(ranked, F.lit(15), 31)
    assert order(kept) == [0, 1]


def test_versioned_patch(spark):
    m = spark.createDataFrame([("a", 1, 0), ("b", 4, None)], "memory_id string, frequency int, version int")
    u = spark.createDataFrame([("a", 9, 0), ("b", 5, 0), ("gone", 1, 0)], "memory_id string, frequency int, expected_version int")
    after, rejected = memory.conditional_patch(m, u, ["frequency"])
    assert {tuple(r) for r in after.select("memory_id", "frequency", "version").collect()} == {("a", 9, 1), ("b", 5, 1)}
    assert [r["memory_id"] for r in rejected.collect()] == ["gone"]
    stale, rejected = memory.conditional_patch(after, u.where("memory_id = 'a'").withColumn("frequency", F.lit(77)), ["frequency"])
    assert stale.where("memory_id = 'a'").first()["frequency"] == 9 and rejected.count() == 1


def test_current_takes_the_highest_version(spark):
    rows = [("a", 1, 5.0), ("a", 2, 1.0), (None, 1, 1.0), ("b", None, 1.0)]
    got = memory.current(spark.createDataFrame(rows, "memory_id string, version int, ingested_at double"))
    assert {(r[0], r[1]) for r in got.collect()} == {("a", 2), ("b", None)}


def test_ingest_defaults(spark):
    rows = spark.createDataFrame([("a", "t", 10.0), ("b", None, None)], "memory_id string, text_content string, recency_ts double")
    got = {r["memory_id"]: r for r in memory.ingest(rows, 30).collect()}
    assert got["a"]["recency_ts"] == 10 and got["b"]["recency_ts"] == 30 and got["b"]["predictive"] == 0.5 and got["a"]["version"] == 0


def test_knn_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "qid int, qv array<float>")
    m = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", [2.0, 2.0]), ("d", None)], "mid string, mv array<float>")
    rows = vector.knn(q, "qid", "qv", m, "mid", "mv", 2, dim=2).orderBy("sim_rank").collect()
    assert [(r["qid"], r["mid"], r["sim"]) for r in rows] == [(1, "b", 0.707107), (1, "c", 0.707107)]
    assert vector.knn(q, "qid", "qv", m.limit(0), "mid", "mv", 2, dim=2).count() == 0


def test_knn_blocks_and_metrics(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 2)
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "qid int, qv array<double>")
    m = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(7)], "mid int, mv array<double>")
    near = vector.knn(q, "qid", "qv", m, "mid", "mv", 1, "euclid", dim=2)
    assert {(r["qid"], r["mid"]) for r in near.collect()} == {(i, i) for i in range(5)}


def test_kappa_and_auroc(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "a int, b int")
    assert stats.kappa(pairs, "a", "b").first()["kappa"] == 0.2
    x = spark.createDataFrame([("g", 1.0, True), ("g", 1.0, False), ("g", 2.0, True), ("h", 1.0, True)], "g string, v double, y boolean")
    got = {r["g"]: r["auc"] for r in stats.auroc(x, "v", "y", ["g"]).collect()}
    assert got == {"g": 0.75, "h": None}


def test_rank_within_equals_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 2 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")).alias("k"), F.md5(F.col("id").cast("string")).alias("t"), "id",
    )
    plain = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("k", "t"))).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    got = rank.rank_within(df, ["g"], "k", "t")
    assert {(r["id"], r["place"], r["n"]) for r in got.collect()} == {(r["id"], r["place"], r["n"]) for r in plain.collect()}
    assert rank.rank_within(df.limit(0), ["g"], "k", "t").count() == 0
