"""Seeded simulations, paired tests and the remaining compositions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions import providers, score as S
from retentia.operators import rank, resample, stats
from retentia.plans.common import CAND, COMP, MEM, RRF, candidates, memories, scored, sql_rerank
from retentia.plans.eviction import _WORDS, _fold_sql, ordered_facts, word_f1
from retentia.plans.registry import Registry
from retentia.plans.scoring import _FACT, facts
from retentia.plans.state import compressed
from retentia.plans.statistics import AUROC_REPLICATES, GRID, REPLICATES, SEED, simplex
from retentia.sources.tables import table

registry = Registry()
add = registry.add


@add(
    "read_score",
    f"""WITH {_FACT}, c AS (SELECT cluster_id, exp(-0.005e0 * greatest(t_end - recency_ts, 0e0) / 3600e0) AS r, least(ln(1e0 + coalesce(mentions, 0)) / ln(51e0), 1e0) AS f,
      (coalesce(len(sessions), 0) + 1e0) / (coalesce(mentions, 0) + 2e0) AS u FROM fact) SELECT cluster_id, round(greatest(0e0, least(1e0, 0.3e0 * r + 0.2e0 * f + 0.3e0 * u + 0.2e0 * 0.5e0)), 6) AS s FROM c""",
)
def read_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite of write-side signals, P at one half."""
    n = F.coalesce("mentions", F.lit(0)).cast("double")
    sessions = F.coalesce(F.when(F.col("sessions").isNotNull(), F.size("sessions")), F.lit(0)).cast("double")
    s = S.composite(S.recency(F.col("recency_ts"), F.col("t_end")), S.frequency(n), (sessions + 1) / (n + 2), F.lit(0.5))
    return facts(spark, sf_dir).select("cluster_id", s.alias("s"))


@add("union_head_tail", f"WITH {CAND} SELECT qid, memory_id, 'head' AS part FROM top WHERE sim_rank <= 5 UNION ALL SELECT qid, memory_id, 'tail' FROM top WHERE sim_rank > 10")
def union_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    part = lambda where, name: c.where(where).select("qid", "memory_id", F.lit(name).alias("part"))
    return part("sim_rank <= 5", "head").unionByName(part("sim_rank > 10", "tail"))


@add(
    "judge_items",
    f"""WITH {sql_rerank(RRF)} SELECT qid, list_sort(list(memory_id) FILTER (WHERE pos <= 5)) AS shown, bool_or(coalesce(frequency, 0) >= 5) FILTER (WHERE pos <= 5) AS evidence FROM final GROUP BY qid""",
)
def judge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is shown, and whether any of it is evidence."""
    top = rank.rerank(candidates(spark, sf_dir), "rrf", 5)
    return top.groupBy("qid").agg(F.array_sort(F.collect_list("memory_id")).alias("shown"), F.bool_or(F.coalesce("frequency", F.lit(0)) >= 5).alias("evidence"))


@add("shadow_vector", f"WITH {MEM} SELECT count(*)::bigint AS n, 0e0 AS largest FROM mem WHERE len(vector) = 64 AND NOT coalesce(is_compressed, false) AND length(text_content) > 200")
def shadow_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest change of any vector value between the store and the rows that `compress` gives, which must be 0."""
    before = memories(spark, sf_dir).where(F.size("vector") == 64).select("memory_id", F.col("vector").alias("before"))
    after = compressed(memories(spark, sf_dir)).select("memory_id", "vector")
    change = F.array_max(F.zip_with("vector", "before", lambda a, b: F.abs(a - b)))
    return before.join(after, "memory_id").agg(F.count("*").alias("n"), F.coalesce(F.max(change), F.lit(0.0)).cast("double").alias("largest"))


@add(
    "delong_paired",
    f"""WITH {COMP}, x AS (SELECT memory_id, u, round(s, 6) AS s, frequency >= 2 AS y FROM scored), n AS (SELECT count(*) FILTER (WHERE y)::double AS m, count(*) FILTER (WHERE NOT y)::double AS k FROM x),
    t AS (SELECT y, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2e0 - rank() OVER (PARTITION BY y ORDER BY u) - (count(*) OVER (PARTITION BY y, u) - 1) / 2e0 AS gu,
      rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 - rank() OVER (PARTITION BY y ORDER BY s) - (count(*) OVER (PARTITION BY y, s) - 1) / 2e0 AS gs FROM x),
    d AS (SELECT (sum(gs) FILTER (WHERE y) - sum(gu) FILTER (WHERE y)) / (any_value(m) * any_value(k)) AS diff,
      sqrt(var_samp((gs - gu) / k) FILTER (WHERE y) / any_value(m) + var_samp((gu - gs) / m) FILTER (WHERE NOT y) / any_value(k)) AS se FROM t, n),
    z AS (SELECT diff, se, diff / nullif(se, 0) AS z, 1 / (1 + 0.5e0 * (abs(diff / nullif(se, 0)) / sqrt(2e0))) AS t FROM d)
    SELECT round(diff, 6) AS diff, round(se, 6) AS se, round(z, 4) AS z, round(t * exp(-z * z / 2 - 1.26551223e0 + t * (1.00002368e0 + t * (0.37409196e0 + t * (0.09678418e0 + t * (-0.18628806e0 + t * (0.27886807e0 + t * (-1.13520398e0 + t * (1.48851587e0 + t * (-0.82215223e0 + t * 0.17087277e0))))))))), 6) AS p FROM z""",
)
def delong_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two scores' AUROC on the same memories and its DeLong standard error."""
    x = scored(spark, sf_dir).select("memory_id", "u", "s", (F.col("frequency") >= 2).alias("y")).withColumn("all", F.lit(1))
    for c in ("u", "s"):
        x = stats.midranks(x, c, ["all"]).withColumnRenamed("midrank", f"z{c}")
        x = stats.midranks(x, c, ["y"]).withColumnRenamed("midrank", f"c{c}")
        x = x.withColumn(f"g{c}", F.col(f"z{c}") - F.col(f"c{c}"))
    n = x.agg(F.sum(F.col("y").cast("int")).cast("double").alias("m"), F.sum((~F.col("y")).cast("int")).cast("double").alias("k"))
    x = x.crossJoin(F.broadcast(n))
    d = F.col("gs") - F.col("gu")
    g = x.groupBy("m", "k").agg(F.sum(F.when(F.col("y"), d)).alias("d"), F.var_samp(F.when(F.col("y"), d / F.col("k"))).alias("v1"), F.var_samp(F.when(~F.col("y"), -d / F.col("m"))).alias("v0"))
    g = g.select((F.col("d") / (F.col("m") * F.col("k"))).alias("diff"), F.sqrt(F.col("v1") / F.col("m") + F.col("v0") / F.col("k")).alias("se"))
    g = g.withColumn("z", F.col("diff") / F.nullif(F.col("se"), F.lit(0.0)))
    return g.select(F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), F.round("z", 4).alias("z"), F.round(stats.normal_p(F.col("z")), 6).alias("p"))


#: Decay rates an hour of the reference's grid, and the share of a dialogue's facts that is kept.
LAMBDAS, KEEP = (0.0005, 0.001, 0.005, 0.01, 0.05), 0.5


_TUNE = f"""WITH {_FACT}, {GRID}, l AS (SELECT unnest([0.0005e0, 0.001e0, 0.005e0, 0.01e0, 0.05e0]) AS rate),
    c AS (SELECT dialogue, md5('evict:' || cluster_id) AS tie, greatest(coalesce(t_end - recency_ts, 0e0), 0e0) / 3600e0 AS hours, least(ln(1e0 + coalesce(mentions, 0)) / ln(51e0), 1e0) AS f,
      (coalesce(len(sessions), 0) + 1e0) / (coalesce(mentions, 0) + 2e0) AS u, coalesce(len(list_filter(sessions, lambda x: x > created_session)) > 0, false) AS needed FROM fact WHERE sessions IS NOT NULL),
    x AS (SELECT rate, wr, wf, wu, wp, dialogue, tie, needed, round(greatest(0e0, least(1e0, wr * exp(-rate * hours) + wf * f + wu * u + wp * 0.5e0)), 6) AS v FROM c, g, l),
    k AS (SELECT *, rank() OVER (PARTITION BY rate, wr, wf, wu, wp ORDER BY v) + (count(*) OVER (PARTITION BY rate, wr, wf, wu, wp, v) - 1) / 2e0 AS mr,
      row_number() OVER (PARTITION BY rate, wr, wf, wu, wp, dialogue ORDER BY v DESC, tie) AS place, count(*) OVER (PARTITION BY rate, wr, wf, wu, wp, dialogue) AS n FROM x),
    a AS (SELECT rate, wr, wf, wu, wp, (sum(mr) FILTER (WHERE needed) - count(*) FILTER (WHERE needed) * (count(*) FILTER (WHERE needed) + 1) / 2e0) / (count(*) FILTER (WHERE needed) * count(*) FILTER (WHERE NOT needed)) AS auc FROM k GROUP BY ALL),
    d AS (SELECT rate, wr, wf, wu, wp, dialogue, count(*) FILTER (WHERE needed AND place > greatest(1, ceil(0.5e0 * n))) / count(*) FILTER (WHERE needed)::double AS harm FROM k GROUP BY ALL HAVING count(*) FILTER (WHERE needed) > 0),
    h AS (SELECT rate, wr, wf, wu, wp, avg(harm) AS harm FROM d GROUP BY ALL)
    SELECT rate AS "lambda", wr, wf, wu, wp, round(auc, 6) AS auc, round(harm, 6) AS harm FROM a JOIN h USING (rate, wr, wf, wu, wp)"""


@add("tune_grid", _TUNE)
def tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of restatement and harmful deletion at half the facts kept, for every weighting and every decay rate."""
    n = F.coalesce("mentions", F.lit(0)).cast("double")
    c = facts(spark, sf_dir).where("sessions IS NOT NULL").select(
        "dialogue", F.md5(F.concat(F.lit("evict:"), F.col("cluster_id"))).alias("tie"), *(S.recency(F.col("recency_ts"), F.col("t_end"), d).alias(f"r{i}") for i, d in enumerate(LAMBDAS)),
        S.frequency(n).alias("f"), ((F.size("sessions") + 1.0) / (n + 2.0)).alias("u"), F.lit(0.5).alias("p"), (F.size(F.filter("sessions", lambda x: x > F.col("created_session"))) > 0).alias("needed"),
    )
    names = ["lambda", "wr", "wf", "wu", "wp"]
    grid = [tuple(g) for g in simplex(spark).select("wr", "wf", "wu", "wp").collect()]
    auc = None
    for i, d in enumerate(LAMBDAS):
        one = stats.auroc_of_weights(c, [f"r{i}", "f", "u", "p"], "needed", names, [((d, *g), g) for g in grid], 22, True)
        auc = one if auc is None else auc.unionByName(one)
    # zeros for the recencies of other rates
    wide = [((d, *g), (*(g[0] if i == j else 0.0 for j in range(len(LAMBDAS))), *g[1:])) for i, d in enumerate(LAMBDAS) for g in grid]
    harm = stats.harm_of_weights(c, "dialogue", "tie", [*(f"r{i}" for i in range(len(LAMBDAS))), "f", "u", "p"], "needed", names, wide, KEEP)
    return auc.join(harm, names).select(*names, F.round("auc", 6).alias("auc"), F.round("harm", 6).alias("harm"))


def _uniform(*keys) -> object:
    """A number in (0, 1) from a hash of the keys; the same wherever the row is computed."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


@add("verdict_noise")
def verdict_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after each verdict was flipped with the given chance: one seeded draw a verdict."""
    rates = _verdicts(spark, sf_dir).withColumn("rate", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.3)))))
    seen = F.when(_uniform(F.lit(7), "memory_id", "good", "i") < F.col("rate"), 1 - F.col("good")).otherwise(F.col("good"))
    return rates.groupBy("rate", "memory_id").agg(F.sum(seen).alias("success_count"), F.sum(1 - seen).alias("failure_count"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, good, i): one row a verdict behind the counters of each memory."""
    m = scored(spark, sf_dir).select("memory_id", "success_count", "failure_count")
    kinds = F.array(F.struct(F.lit(1).alias("good"), F.col("success_count").alias("n")), F.struct(F.lit(0).alias("good"), F.col("failure_count").alias("n")))
    each = m.select("memory_id", F.explode(kinds).alias("k")).where("k.n > 0")
    return each.select("memory_id", F.col("k.good").alias("good"), F.explode(F.sequence(F.lit(1), F.col("k.n").cast("int"))).alias("i"))


@add("verdict_subsample")
def verdict_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters when only a share of the verdicts is seen: one seeded draw a verdict."""
    rates = _verdicts(spark, sf_dir).withColumn("share", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0)))))
    seen = rates.where(_uniform(F.lit(8), "memory_id", "good", "i") < F.col("share"))
    return seen.groupBy("share", "memory_id").agg(F.sum("good").alias("success_count"), F.sum(1 - F.col("good")).alias("failure_count"))


@add("verdict_asymmetric")
def verdict_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters when good verdicts are missed and bad ones taken for good at different rates."""
    pairs = F.array(*(F.struct(F.lit(a).alias("miss"), F.lit(b).alias("false")) for a, b in ((0.1, 0.3), (0.3, 0.1))))
    each = _verdicts(spark, sf_dir).withColumn("r", F.explode(pairs)).select("memory_id", "good", "i", "r.*")
    turned = _uniform(F.lit(9), "memory_id", "good", "i") < F.when(F.col("good") == 1, F.col("miss")).otherwise(F.col("false"))
    seen = F.when(turned, 1 - F.col("good")).otherwise(F.col("good"))
    return each.groupBy("miss", "false", "memory_id").agg(F.sum(seen).alias("success_count"), F.sum(1 - seen).alias("failure_count"))


@add("reliability_curve")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far noisy counters still order memories as clean ones do: AUROC of smoothed success by noise rate."""
    noisy = verdict_noise(spark, sf_dir)
    clean = scored(spark, sf_dir).select("memory_id", (F.col("u") > 0.5).alias("y"))
    x = noisy.join(clean, "memory_id").select("rate", F.round(S.utility(F.col("success_count").cast("double"), F.col("failure_count").cast("double")), 9).alias("v"), "y")
    law = F.round(F.pow(F.lit(1.0) - 2 * F.col("rate"), 2), 6)
    return stats.auroc(x, "v", "y", ["rate"]).withColumn("law", law)


#: Draws, and the Dirichlet total that gives the default weights a mean coefficient of variation of 0.2.
DRAWS = 1_000
TOTAL = sum((1 - w) / w for w in S.WEIGHTS.values()) / len(S.WEIGHTS) / 0.2**2 - 1


@add("weight_perturbations")
def weight_perturbations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of memories that change tier under each of 1,000 Dirichlet draws around the default weights.

    Components meet as counts first; a task weighs its rows by all draws and sends one count a draw.
    """
    rng = np.random.default_rng(11)
    weights = rng.dirichlet([TOTAL * w for w in S.WEIGHTS.values()], DRAWS)
    m = scored(spark, sf_dir).select(*"rfup", "s")

    def count(batches):
        changed, n = np.zeros(DRAWS, dtype=np.int64), 0
        tier = lambda s: np.where(s > S.RETAIN, 2, np.where(s > S.COMPRESS, 1, 0))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "rfup"], axis=1)
            before = tier(batch.column("s").to_numpy(zero_copy_only=False))
            for part, old in zip(np.array_split(x, max(1, len(x) // 2048)), np.array_split(before, max(1, len(x) // 2048))):
                after = tier(np.floor(np.clip(part @ weights.T, 0.0, 1.0) * 1e6 + 0.5) / 1e6)
                changed += (after != old[:, None]).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(DRAWS), pa.int32()), pa.array(changed), pa.array([n] * DRAWS, pa.int64())], ["draw", "changed", "n"])

    return m.mapInArrow(count, "draw int, changed long, n long").groupBy("draw").agg(F.round(F.sum("changed") / F.sum("n"), 6).alias("changed"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialogue, cluster_id, needed, one column a score) of facts with sessions: what the confirmatory family compares."""
    n = F.coalesce("mentions", F.lit(0)).cast("double")
    r, f, u = S.recency(F.col("recency_ts"), F.col("t_end")), S.frequency(n), (F.size("sessions") + 1.0) / (n + 2.0)
    days = F.greatest(F.col("t_end") - F.col("recency_ts"), F.lit(0.0)) / 86400.0
    columns = {"composite": S.composite(r, f, u, F.lit(0.5)), "recency": F.col("recency_ts"), "age": F.col("created_ts"), "mention": n, "utility": F.round(u, 9), "forgetting": F.round(F.exp(-days / (F.lit(1.0) + n)), 9)}
    needed = F.size(F.filter("sessions", lambda x: x > F.col("created_session"))) > 0
    return facts(spark, sf_dir).where("sessions IS NOT NULL").select("dialogue", "cluster_id", needed.alias("needed"), *(F.coalesce(c, F.lit(0.0)).alias(name) for name, c in columns.items()))


#: (id, endpoint, a, b, predicted sign of a - b).
FAMILY = (
    ("F1", "auroc", "composite", "recency", 1), ("F2", "auroc", "composite", "mention", 1), ("F3", "auroc", "utility", "forgetting", 1),
    ("F4", "harm", "composite", "recency", -1), ("F5", "harm", "composite", "age", -1),
)


def _harm(rows: DataFrame, score: str, keep: float = KEEP) -> DataFrame:
    """(dialogue, harm): share of a dialogue's needed facts that keeping its best facts by `score` loses."""
    f = rows.select("dialogue", "needed", (-F.col(score)).alias("k"), F.md5(F.concat(F.lit("evict:"), F.col("cluster_id"))).alias("tie"))
    f = rank.rank_within(f, ["dialogue"], "k", "tie", "rk").withColumn("lost", F.col("rk") > F.greatest(F.lit(1), F.ceil(F.col("n") * keep)))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return f.groupBy("dialogue").agg(one(F.col("needed") & F.col("lost")).alias("a"), one(F.col("needed")).alias("b")).where("b > 0").select("dialogue", (F.col("a") / F.col("b")).alias("harm"))


def decided(family: DataFrame, level: float = 0.05) -> DataFrame:
    """`family` (id, diff, p, sign) with Holm's p over all rows and the direction-aware result."""
    f = stats.holm(family.withColumn("__all", F.lit("all")), "id", "p", "__all").drop("__all").withColumnRenamed("adjusted", "holm_p")
    there = F.signum("diff") == F.col("sign")
    return f.withColumn("result", F.when((F.col("holm_p") < level) & there, "confirmed").when(F.col("holm_p") < level, "significant, opposite direction").otherwise("not confirmed"))


@add("confirm_family")
def confirm_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmatory family: paired differences of AUROC and of harmful deletion, dialogues as clusters, Holm's p, result."""
    rows = _scores(spark, sf_dir)
    out = None
    for name, endpoint, a, b, sign in FAMILY:
        if endpoint == "auroc":
            d = resample.auroc_replicates(rows, "dialogue", [a, b], "needed", AUROC_REPLICATES, SEED).select((F.col(a) - F.col(b)).alias("d"))
        else:
            pair = _harm(rows, a).withColumnRenamed("harm", "x").join(_harm(rows, b).withColumnRenamed("harm", "y").withColumnRenamed("dialogue", "other"), F.col("dialogue").eqNullSafe(F.col("other")))
            d = resample.mean_replicates(pair.select("dialogue", F.round(F.col("x") - F.col("y"), 9).alias("x")), "dialogue", "x", REPLICATES, SEED).select(F.col("mean").alias("d"))
        one = d.agg(F.round(F.avg("d"), 6).alias("diff"), *resample.interval(d, "d"), F.round(resample.two_sided("d"), 6).alias("p"))
        one = one.select(F.lit(name).alias("id"), F.lit(endpoint).alias("endpoint"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(sign).alias("sign"), "*")
        out = one if out is None else out.unionByName(one)
    return decided(out)


def store(pdf: pd.DataFrame) -> pd.DataFrame:
    """One speaker's facts in order of creation: the stored fact of the best F1, the first of equals, is mentioned again."""
    place: dict[str, int] = {}
    mentions: dict[str, int] = {}
    pdf = pdf.sort_values(["created_ts", "cluster_id"], na_position="first")
    for c, near in zip(pdf.cluster_id, pdf.near):
        hits = [x for x in (near if near is not None else ()) if x["y"] in place]
        if hits:
            mentions[min(hits, key=lambda x: (-x["f1"], place[x["y"]]))["y"]] += 1
        else:
            place[c], mentions[c] = len(place), 1
    return pdf.iloc[: len(place)].assign(cluster_id=list(mentions), mentions=list(mentions.values()))[["dialogue", "cluster_id", "mentions"]]


_BEST = """list_sort(list_filter(list_transform(k.near, lambda e: {'f': -e.f1, 'at': list_position(rec.leaders, e.y), 'y': e.y}), lambda e: e.at > 0))[1].y"""


@add("fuzzy_ingest", f"WITH RECURSIVE {_WORDS}, n6 AS (SELECT * FROM f1 WHERE f1 >= 0.6e0), {_fold_sql('n6', _BEST)} SELECT dialogue, leader AS cluster_id, count(*)::bigint AS mentions FROM rec GROUP BY dialogue, leader")
def fuzzy_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts met in order of time: one at F1 0.6 or more to stored facts of its speaker raises the mentions of the best of them.

    Order-dependent per speaker and dialogue; the fold gets ids and edges, never texts or pairs below the threshold.
    """
    rows = ordered_facts(spark, sf_dir, word_f1(spark, sf_dir, 0.6))
    return rows.groupBy("dialogue", "speaker").applyInPandas(store, "dialogue long, cluster_id string, mentions long")


@add(
    "hashed_vectors",
    f"""WITH {MEM}, t AS (SELECT memory_id, regexp_extract_all(lower(text_content), '[a-z0-9]+') AS w FROM mem WHERE text_content IS NOT NULL), h AS (SELECT memory_id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint) AS h FROM t),
    v AS (SELECT memory_id, list_transform(range(0, 64), lambda d: coalesce(list_sum(list_transform(list_filter(h, lambda x: x % 64 = d), lambda x: CASE WHEN x // 64 % 2 = 0 THEN 1e0 ELSE -1e0 END)), 0e0)) AS v FROM h)
    SELECT memory_id, list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN round(x / sqrt(list_dot_product(v, v)), 6) ELSE x END) AS vector FROM v""",
)
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline encoder over every memory text."""
    m = memories(spark, sf_dir).where("text_content IS NOT NULL")
    return m.select("memory_id", F.transform(providers.hashing_vector(F.col("text_content"), unit=True), lambda x: F.round(x, 6)).alias("vector"))


@add(
    "lexical_verdicts",
    """WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(item_text, '')), '[a-z0-9]+') AS a, list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+')) AS t FROM eval_items)
    SELECT item_id, CASE WHEN len(t) = 0 THEN 'NEUTRAL' WHEN len(list_filter(t, lambda x: list_contains(a, x))) / len(t)::double >= 0.5e0 THEN 'YES' ELSE 'NO' END AS verdict FROM w""",
)
def lexical_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline judge over the evaluation items."""
    return table(spark, sf_dir, "eval_items").select("item_id", providers.lexical_verdict(F.col("item_text"), F.col("answer")).alias("verdict"))
