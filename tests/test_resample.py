"""The bootstrap against closed forms and plain resampling; exact tests against whole sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import resample, stats
from retentia.plans import extras


def clustered(spark, seed=1, clusters=40):
    rng = np.random.default_rng(seed)
    rows = [(f"c{c}", round(float(rng.normal(0.1 * c / clusters + rng.normal() * 0.2, 0.3)), 2), round(float(rng.random()), 1), bool(rng.random() < 0.4)) for c in range(clusters) for _ in range(int(rng.integers(1, 12)))]
    return spark.createDataFrame(rows, "c string, v double, s double, y boolean").repartition(5), rows


def test_mean_has_the_spread_of_plain_two_stage_resampling(spark):
    df, rows = clustered(spark)
    got = np.array([r["mean"] for r in resample.mean_replicates(df, "c", "v", 2000, 3).collect()])
    by = {}
    for c, v, *_ in rows:
        by.setdefault(c, []).append(v)
    groups, rng = [np.array(x) for x in by.values()], np.random.default_rng(0)
    plain = []
    for _ in range(2000):
        drawn = [rng.choice(groups[g], len(groups[g])) for g in rng.integers(0, len(groups), len(groups))]
        plain.append(np.concatenate(drawn).mean())
    assert got.mean() == pytest.approx(np.mean([v for _, v, *_ in rows]), abs=0.01)
    assert got.std() == pytest.approx(np.std(plain), rel=0.1)


def test_single_items_have_no_variance_within(spark):
    """Clusters of one item: the spread is that of the ordinary bootstrap, sd / sqrt(n)."""
    x = np.random.default_rng(2).normal(size=400)
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(x)], "c string, v double")
    got = np.array([r["mean"] for r in resample.mean_replicates(df, "c", "v", 2000, 5).collect()])
    assert got.std() == pytest.approx(x.std() / 20, rel=0.08)


def test_draws_do_not_depend_on_partitions(spark):
    df, _ = clustered(spark)
    for f in (lambda d: resample.mean_replicates(d, "c", "v", 50, 3), lambda d: resample.auroc_replicates(d, "c", ["v", "s"], "y", 50, 3)):
        a, b = ({r["replicate"]: tuple(round(x, 9) for x in r[1:]) for r in f(d).collect()} for d in (df, df.repartition(2)))
        assert a == b and len(a) == 50


def test_auroc_spread(spark):
    df, rows = clustered(spark, clusters=60)
    b = {r["replicate"]: r for r in resample.auroc_replicates(df, "c", ["v", "s"], "y", 600, 4).collect()}
    v, s, y = (np.array([r[i] for r in rows]) for i in (1, 2, 3))

    def auc(x, y):
        d = x[y][:, None] - x[~y][None, :]
        return ((d > 0) + (d == 0) / 2).mean()

    ids = np.array([r[0] for r in rows])
    groups, rng, plain = [np.flatnonzero(ids == c) for c in np.unique(ids)], np.random.default_rng(0), []
    for _ in range(600):
        ix = np.concatenate([rng.choice(groups[g], len(groups[g])) for g in rng.integers(0, len(groups), len(groups))])
        plain.append(auc(v[ix], y[ix]) - auc(s[ix], y[ix]))
    d = np.array([r["v"] - r["s"] for r in b.values()])
    assert len(d) == 600 and d.mean() == pytest.approx(auc(v, y) - auc(s, y), abs=0.02) and d.std() == pytest.approx(np.std(plain), rel=0.15)


def test_cells_keep_their_total(spark):
    df, rows = clustered(spark)
    n = resample.cell_replicates(df.withColumn("p", F.col("v") > 0), "c", ["p", "y"], 800, 6).groupBy("replicate").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
    assert n == pytest.approx(len(rows), rel=0.02)


def test_exact_tails():
    for n in (1, 7, 40, 1000):
        for k in (0, n // 3, n // 2):
            assert stats.binomial_half_tail(k, n) == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert stats.binomial_half_tail(2400, 5000) == pytest.approx(sum(math.comb(5000, i) for i in range(2401)) / 2**5000, rel=1e-9)


def test_normal_and_text(spark):
    row = spark.createDataFrame([(0.0, 1.0), (1.959964, 0.0412345), (-4.0, 0.00002)], "z double, p double").select(stats.normal_p(F.col("z")).alias("p"), stats.format_p(F.col("p"), 1e-4).alias("t")).collect()
    assert [r["p"] for r in row] == pytest.approx([1.0, 0.05, 6.334e-5], abs=1e-6)
    assert [r["t"] for r in row] == ["1", "0.0412", "< 1e-04"]


def test_decisions(spark):
    f = spark.createDataFrame([("a", 0.1, 0.001, 1), ("b", -0.1, 0.002, 1), ("c", 0.1, 0.04, 1)], "id string, diff double, p double, sign int")
    got = {r["id"]: (r["holm_p"], r["result"]) for r in extras.decided(f).collect()}
    assert got == {"a": (0.003, "confirmed"), "b": (0.004, "significant, opposite direction"), "c": (0.04, "confirmed")}
