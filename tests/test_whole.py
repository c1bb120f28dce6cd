"""Queries over all contexts, vectors, weightings and lines, against brute force."""

import datetime
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from retentia.operators import lexical, stats, vector
from retentia.plans import eviction, extras, state, statistics

SF = f"{oracle.DATA}/sf0.01"


def test_every_context_is_answered(spark):
    got = eviction.asof_visible(spark, SF)
    first = eviction.memories(spark, SF).agg(F.min("created_ts")).first()[0]
    asked = [r["context_id"] for r in eviction.table(spark, SF, "contexts").where(F.unix_micros("created_at") / 1e6 >= first).collect()]
    assert sorted(r["context_id"] for r in got.collect()) == sorted(asked) and any(c % 20 for c in asked)


def stored_and_asked(spark):
    """Memories and contexts of a few hours, with equal times, equal frequencies and contexts before any memory."""
    rng = np.random.default_rng(3)
    m = [(f"m{i}", int(rng.integers(0, 6)) if i % 9 else None, float(rng.integers(20, 200) * 600)) for i in range(150)]
    q = [(i, float(rng.integers(0, 220) * 600)) for i in range(60)]
    contexts = spark.createDataFrame([(i, datetime.datetime.fromtimestamp(t, datetime.UTC)) for i, t in q], "context_id long, created_at timestamp")
    return spark.createDataFrame(m, "memory_id string, frequency long, created_ts double"), contexts, m, q


def test_visible_at_equals_brute_force(spark):
    memories, contexts, m, q = stored_and_asked(spark)
    before = {i: [(at, k) for k, _, at in m if at <= t] for i, t in q}
    assert {tuple(r) for r in eviction.visible_at(contexts, memories).collect()} == {(i, len(x), max(x)[1]) for i, x in before.items() if x}


def test_shown_to_equals_brute_force(spark):
    memories, contexts, m, q = stored_and_asked(spark)
    shown = {}
    for i, t in q:
        for _, k in sorted((1 if f is None else -f, k) for k, f, at in m if at <= t)[:5]:
            shown.setdefault(k, []).append(i)
    assert {tuple(r) for r in eviction.shown_to(contexts, memories).collect()} == {(k, len(x), max(x)) for k, x in shown.items()}


@pytest.mark.parametrize("block", [7, 2048])
def test_pairs_within_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK_PAIRS", block)
    x = np.random.default_rng(5).normal(size=(60, 4))
    rows = [(i, i % 3, x[i].tolist()) for i in range(60)] + [(60, None, [1.0] * 4), (61, 0, None), (62, 0, [0.0] * 4)]
    got = vector.pairs_within(spark.createDataFrame(rows, "k long, g int, v array<double>"), "g", "k", "v", 0.4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(a, b): unit[a] @ unit[b] for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3 and unit[a] @ unit[b] >= 0.4}
    assert {(r["a"], r["b"]): r["cos"] for r in got.collect()} == pytest.approx(want, abs=1e-6)
    assert any(a % 20 for a, _ in want)


@pytest.mark.parametrize("rows", [16, 1 << 20])
def test_auroc_of_weights_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(stats, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(2)
    x = np.round(rng.random((90, 2)) * 1.5 - 0.3, 1)  # ties, and sums outside 0 to 1
    y = rng.random(90) < 0.4
    df = spark.createDataFrame([(*map(float, v), bool(b)) for v, b in zip(x, y)] + [(0.5, 0.5, None)], "a double, b double, y boolean")
    configs = [((i / 30,), (i / 30, 1 - i / 30)) for i in range(31)]
    got = {r["w"]: (r["auc"], r["n_pos"], r["n_neg"]) for r in stats.auroc_of_weights(df, ["a", "b"], "y", ["w"], configs).collect()}
    assert len(got) == 31
    for (w,), (p, q) in configs:
        v = np.round(p * x[:, 0] + q * x[:, 1], 6)
        d = v[y][:, None] - v[~y][None, :]
        assert got[w] == (pytest.approx(((d > 0) + (d == 0) / 2).mean(), abs=1e-12), y.sum(), (~y).sum())


def test_all_weightings_are_scored_and_the_best_is_chosen(spark):
    got = {tuple(r)[:4]: r["auc"] for r in statistics.auroc_grid(spark, SF).collect()}
    assert len(got) == 286 and (1.0, 0.0, 0.0, 0.0) in got
    best = statistics.select_config(spark, SF).first()
    assert best["auc"] == max(got.values())


def test_best_config_outside_the_planes_and_ties(spark):
    rows = [(0.3, 0.2, 0.3, 0.2, 0.8), (1.0, 0.0, 0.0, 0.0, 0.9), (0.0, 1.0, 0.0, 0.0, 0.9), (0.4, 0.1, 0.3, 0.2, 0.9 - 1e-9)]
    t = spark.createDataFrame(rows, "wr double, wf double, wu double, wp double, auc double")
    assert tuple(statistics.best_config(t).first()) == (1.0, 0.0, 0.0, 0.0, 0.9)


def test_files_are_packed_in_one_pass(spark):
    rng = np.random.default_rng(4)
    files = {"long": rng.integers(4, 900, 4500).tolist(), "short": [100] * 120, "large": [9000, 9000, 5], None: [4, 4]}
    rows = [(name, i, int(t)) for name, ts in files.items() for i, t in enumerate(ts)]
    want = {}
    for name, ts in files.items():
        part, batch = 0, []
        for i, t in enumerate(ts):
            if batch and (len(batch) >= 50 or sum(batch) + t > 8000):
                part, batch = part + 1, []
            batch.append(t)
            want[name, i] = part
    got = state.packed(spark.createDataFrame(rows, "batch_id string, line_no int, tokens long").repartition(7))
    assert {(r["batch_id"], r["line_no"]): r["part"] for r in got.collect()} == want


def test_every_weighting_and_rate_is_tuned(spark):
    """Equals the AUROC and the deletion of plain loops over all facts."""
    f = extras.facts(spark, SF).where("sessions IS NOT NULL").withColumn("tie", F.md5(F.concat(F.lit("evict:"), F.col("cluster_id")))).toPandas().sort_values("tie")
    got = {tuple(r)[:5]: (r["auc"], r["harm"]) for r in extras.tune_grid(spark, SF).collect()}
    assert len(got) == 1430
    mentions = f.mentions.fillna(0).to_numpy(float)
    y = np.array([any(x > c for x in s) for s, c in zip(f.sessions, f.created_session)])
    u = (np.array([len(s) for s in f.sessions]) + 1.0) / (mentions + 2.0)
    for lam, wr, wf, wu, wp in [(0.0005, 1.0, 0.0, 0.0, 0.0), (0.005, 0.3, 0.2, 0.3, 0.2), (0.05, 0.4, 0.1, 0.1, 0.4), (0.01, 0.0, 0.0, 0.0, 1.0)]:
        r = np.exp(-lam * np.maximum((f.t_end - f.recency_ts).fillna(0.0), 0.0) / 3600.0).to_numpy()  # a missing time counts as now
        v = np.round(np.clip(wr * r + wf * np.minimum(np.log1p(mentions) / np.log(51.0), 1.0) + wu * u + wp * 0.5, 0.0, 1.0), 6)
        d = v[y][:, None] - v[~y][None, :]
        harms = []
        for _, ix in f.reset_index(drop=True).groupby("dialogue", dropna=False).groups.items():
            ix = np.array(ix)
            if y[ix].any():
                gone = ix[np.argsort(-v[ix], kind="stable")][max(1, int(np.ceil(0.5 * len(ix)))) :]
                harms.append(y[gone].sum() / y[ix].sum())
        assert got[lam, wr, wf, wu, wp] == pytest.approx((((d > 0) + (d == 0) / 2).mean(), np.mean(harms)), abs=2e-6)


@pytest.mark.parametrize("block", [5, 8192])
def test_nearest_bag_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_BAGS", block)
    rng = np.random.default_rng(3)
    rows = [(f"k{i:02d}", i % 3, " ".join(f"w{w % 12}" for w in rng.zipf(1.4, size=rng.integers(1, 9)))) for i in range(70)]
    rows += [("n0", None, "w1"), ("n1", 0, None), ("n2", 0, "?"), ("n3", 0, "alone"), ("n4", 9, "w1")]
    bags = [(k, g, Counter(t.split())) for k, g, t in rows if t and g is not None]
    want = {}
    for k, g, x in bags:
        f1 = [(-round(2 * (x & y).total() / (x.total() + y.total()), 6), other) for other, h, y in bags if h == g and other != k and x & y]
        if f1:
            want[k] = (min(f1)[1], -min(f1)[0])
    got = lexical.nearest_bag(spark.createDataFrame(rows, "k string, g int, t string"), ["g"], "k", "t")
    assert {r["k"]: (r["other"], r["f1"]) for r in got.collect()} == want
    assert len(want) == 70


def test_best_match_sends_no_pairs(spark, tmp_path):
    """A speaker's 400 facts share their words: 79,800 pairs, but no step gives more than a few rows a fact."""
    rows = [(f"c{i:03d}", 1, 1, f"i met my friend number n{i} at the lake in town t{i // 2}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "cluster_id string, dialogue long, speaker int, canonical string, mentions int")
    df.selectExpr("*", "1D AS recency_ts", "array(canonical) AS variants").write.parquet(str(tmp_path / "fact_clusters.parquet"))
    got = eviction.best_match(spark, str(tmp_path))
    assert {r["cluster_id"]: r["best"] for r in got.collect()} == {f"c{i:03d}": f"c{i ^ 1:03d}" for i in range(400)}

    def most(plan) -> int:
        kind, made = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        below = [*inner, *(plan.children().apply(i) for i in range(plan.children().size()))]
        return max([made.get().value() if made.isDefined() else 0, *map(most, below)])

    assert 400 <= most(got._jdf.queryExecution().executedPlan()) <= 2_000
