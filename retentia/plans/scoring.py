"""Scores, tiers and scalar transforms over the memory table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.functions import score as S
from retentia.operators import memory, vector
from retentia.plans.common import COMP, MEM, NOW, memories, rounded, scored
from retentia.plans.registry import Registry
from retentia.sources.tables import table

registry = Registry()
add = registry.add


def _component(name: str, column: str) -> None:
    @add(name, f"WITH {COMP} SELECT memory_id, round({column}, 6) AS {column} FROM comp")
    def component(spark: SparkSession, sf_dir: str, column: str = column) -> DataFrame:
        return rounded(memory.with_components(memories(spark, sf_dir), NOW).select("memory_id", column), column)


for _name, _column in (("score_recency", "r"), ("score_frequency", "f"), ("score_utility", "u")):
    _component(_name, _column)


@add("score_components", f"WITH {COMP} SELECT memory_id, round(r, 6) AS r, round(f, 6) AS f, round(u, 6) AS u, round(p, 6) AS p FROM comp")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.with_components(memories(spark, sf_dir), NOW).select("memory_id", *"rfup"), *"rfup")


@add(
    "score_predictive",
    f"""WITH {MEM}, goal AS (SELECT embedding::double[] AS g FROM embeddings WHERE vec_id = 0)
    SELECT memory_id, round(greatest(0e0, least(1e0, coalesce(predictive, CASE WHEN len(vector) = 64 THEN
      CASE WHEN list_dot_product(vector::double[], vector::double[]) > 0 THEN list_dot_product(g, vector::double[]) / (sqrt(list_dot_product(g, g))
        * sqrt(list_dot_product(vector::double[], vector::double[]))) ELSE 0e0 END END, 0.5e0))), 6) AS p FROM mem, goal""",
)
def score_predictive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial P: the explicit value, else the clipped goal cosine, else one half."""
    goal = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"]
    near = F.when(F.size("vector") == len(goal), vector.cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in goal))))
    return memories(spark, sf_dir).select("memory_id", F.round(S.clip01(F.coalesce("predictive", near, F.lit(0.5))), 6).alias("p"))


@add("retention_score", f"WITH {COMP} SELECT memory_id, s FROM scored")
def retention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("memory_id", "s")


_TIER = "CASE WHEN s > 0.7e0 THEN 'retain' WHEN s > 0.3e0 THEN 'compress' ELSE 'delete' END"


@add("classify", f"WITH {COMP} SELECT memory_id, s, {_TIER} AS tier FROM scored")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("memory_id", "s", S.tier(F.col("s")).alias("tier"))


@add(
    "normalize_weights",
    f"""WITH {COMP}, m AS (SELECT avg(r) AS r, avg(f) AS f, avg(u) AS u, avg(p) AS p FROM comp) SELECT component, round(x / (r + f + u + p), 6) AS weight FROM (SELECT unnest(['r', 'f', 'u', 'p']) AS component, unnest([r, f, u, p]) AS x, r, f, u, p FROM m)""",
)
def normalize_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean components of the store as weights scaled to sum 1."""
    m = memory.with_components(memories(spark, sf_dir), NOW).agg(*(F.avg(c).alias(c) for c in "rfup"))
    total = F.col("r") + F.col("f") + F.col("u") + F.col("p")
    each = F.array(*(F.struct(F.lit(c).alias("component"), F.round(F.col(c) / total, 6).alias("weight")) for c in "rfup"))
    return m.select(F.explode(each).alias("w")).select("w.*")


@add(
    "ablation_scores",
    f"""WITH {COMP}, w AS (SELECT * FROM (VALUES ('r', 0e0, 0.2e0 / 0.7e0, 0.3e0 / 0.7e0, 0.2e0 / 0.7e0), ('f', 0.3e0 / 0.8e0, 0e0, 0.3e0 / 0.8e0, 0.2e0 / 0.8e0),
      ('u', 0.3e0 / 0.7e0, 0.2e0 / 0.7e0, 0e0, 0.2e0 / 0.7e0), ('p', 0.3e0 / 0.8e0, 0.2e0 / 0.8e0, 0.3e0 / 0.8e0, 0e0)) AS t(without, wr, wf, wu, wp))
    SELECT memory_id, without, round(greatest(0e0, least(1e0, wr * r + wf * f + wu * u + wp * p)), 6) AS s FROM comp, w""",
)
def ablation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score without each component, the other weights scaled up."""
    comp = memory.with_components(memories(spark, sf_dir), NOW)
    each = [F.struct(F.lit(gone).alias("without"), S.composite(*(F.col(c) for c in "rfup"), w).alias("s")) for gone, w in S.leave_one_out(S.WEIGHTS).items()]
    return comp.select("memory_id", F.explode(F.array(*each)).alias("a")).select("memory_id", "a.*")


@add(
    "counter_update",
    f"""WITH {MEM} SELECT memory_id, coalesce(success_count, 0) + 1 AS success_count, coalesce(failure_count, 0) AS failure_count, coalesce(frequency, 0) + 1 AS frequency,
      round((coalesce(success_count, 0) + 2e0) / (coalesce(success_count, 0) + 1 + coalesce(failure_count, 0) + 2), 6) AS utility, {NOW}e0 AS recency_ts FROM mem""",
)
def counter_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every memory after one more success now; utility is the smoothed rate of the new counts."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    m = memories(spark, sf_dir).select("memory_id", (n("success_count") + 1).alias("success_count"), n("failure_count").alias("failure_count"), (n("frequency") + 1).alias("frequency"))
    rate = F.round(S.utility(F.col("success_count").cast("double"), F.col("failure_count").cast("double")), 6)
    return m.select("*", rate.alias("utility"), F.lit(NOW).alias("recency_ts"))


_URGENT = "coalesce(list_contains(tags, 'system:high_priority_distillation'), false)"
_YOUNG = f"({NOW}e0 - coalesce(created_ts, 0e0) < 86400e0 OR {NOW}e0 - coalesce(recency_ts, 0e0) < 86400e0)"
#: What maintenance does with a scored memory.
ACTION_SQL = f"""CASE WHEN {_URGENT} THEN 'compress' WHEN {_YOUNG} THEN 'grace' WHEN s > 0.7e0 THEN 'retain' WHEN s > 0.3e0 THEN
      CASE WHEN coalesce(is_compressed, false) THEN 'skip' ELSE 'compress' END ELSE 'delete' END"""


def action():
    """What maintenance does with a scored memory.

    A memory in the distillation queue is compressed whatever its age and score; others are left alone while young, and
    what is compressed isn't compressed again. A missing time counts as long ago.
    """
    urgent = S.queued(F.col("tags"))
    zero = F.lit(0.0)
    young = S.grace(F.coalesce("created_ts", zero), F.coalesce("recency_ts", zero), NOW, 24.0)
    tier = S.tier(F.col("s"))
    again = (tier == "compress") & F.coalesce("is_compressed", F.lit(False))
    return F.when(urgent, "compress").when(young, "grace").when(again, "skip").otherwise(tier)


@add("triage_actions", f"WITH {COMP} SELECT memory_id, s, {ACTION_SQL} AS action FROM scored")
def triage_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What maintenance would do with each memory."""
    return scored(spark, sf_dir).select("memory_id", "s", action().alias("action"))


@add("token_band", "SELECT doc_id, n_tokens FROM documents WHERE n_tokens BETWEEN 200 AND 400")
def token_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("n_tokens").between(200, 400)).select("doc_id", "n_tokens")


@add("min_length", "SELECT doc_id, length(text)::int AS length FROM documents WHERE length(text) >= 2001")
def min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.length("text") >= 2001).select("doc_id", F.length("text").alias("length"))


# Write-side signals of fact clusters; repeated rows of a cluster count once.
_FACT = """fact AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mentions DESC NULLS LAST, recency_ts DESC NULLS LAST,
  len(variants) DESC NULLS LAST) AS rn FROM fact_clusters WHERE cluster_id IS NOT NULL) WHERE rn = 1)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("mentions"), F.desc_nulls_last("recency_ts"), F.when(F.col("variants").isNotNull(), F.size("variants")).desc_nulls_last())
    return table(spark, sf_dir, "fact_clusters").where("cluster_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


_WRITE = """exp(-0.005e0 * greatest(t_end - recency_ts, 0e0) / 3600e0)"""


@add(
    "write_score",
    f"""WITH {_FACT} SELECT cluster_id, round({_WRITE}, 6) AS r_w, round(least(ln(1e0 + coalesce(mentions, 0)) / ln(51e0), 1e0), 6) AS f_w,
      round((coalesce(len(sessions), 0) + 1e0) / (coalesce(mentions, 0) + 2e0), 6) AS u_w FROM fact""",
)
def write_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, frequency and utility of writing: last restatement, mentions, sessions per mention."""
    n = F.coalesce("mentions", F.lit(0)).cast("double")
    sessions = F.coalesce(F.when(F.col("sessions").isNotNull(), F.size("sessions")), F.lit(0)).cast("double")
    f = facts(spark, sf_dir).select(
        "cluster_id", S.recency(F.col("recency_ts"), F.col("t_end")).alias("r_w"), S.frequency(n).alias("f_w"), ((sessions + 1) / (n + 2)).alias("u_w")
    )
    return rounded(f, "r_w", "f_w", "u_w")


@add(
    "restated_sessions",
    f"WITH {_FACT} SELECT cluster_id, coalesce(len(list_distinct(list_filter(sessions, lambda x: x > created_session))), 0)::int AS n FROM fact WHERE sessions IS NOT NULL",
)
def restated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.array_distinct(F.filter("sessions", lambda x: x > F.col("created_session")))
    return facts(spark, sf_dir).where("sessions IS NOT NULL").select("cluster_id", F.size(later).alias("n"))


@add(
    "forgetting_curve_score",
    f"WITH {MEM} SELECT memory_id, round(exp(-(greatest({NOW}e0 - coalesce(recency_ts, created_ts), 0e0) / 86400e0) / (1e0 + frequency)), 6) AS score FROM mem",
)
def forgetting_curve_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp(-days / (1 + frequency))."""
    days = F.greatest(F.lit(NOW) - F.coalesce("recency_ts", "created_ts"), F.lit(0.0)) / 86400.0
    return memories(spark, sf_dir).select("memory_id", F.round(F.exp(-days / (F.lit(1.0) + F.col("frequency"))), 6).alias("score"))


@add(
    "recency_importance_score",
    f"""WITH {_FACT}, a AS (SELECT cluster_id, dialogue, pow(0.995e0, greatest(t_end - recency_ts, 0e0) / 3600e0) AS rec, coalesce(mentions, 0)::double AS imp FROM fact),
    b AS (SELECT *, min(rec) OVER w AS r0, max(rec) OVER w AS r1, min(imp) OVER w AS i0, max(imp) OVER w AS i1 FROM a WINDOW w AS (PARTITION BY dialogue))
    SELECT cluster_id, round(CASE WHEN r1 > r0 THEN (rec - r0) / (r1 - r0) ELSE 0e0 END + CASE WHEN i1 > i0 THEN (imp - i0) / (i1 - i0) ELSE 0e0 END, 6) AS score FROM b""",
)
def recency_importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency 0.995^hours plus importance, each min-max scaled in its dialogue; no spread scales to 0.

    The minima and maxima come from a pre-aggregation, so a dialogue with a third of all facts is no hot task.
    """
    a = facts(spark, sf_dir).select(
        "cluster_id", "dialogue", F.pow(F.lit(0.995), F.greatest(F.col("t_end") - F.col("recency_ts"), F.lit(0.0)) / 3600.0).alias("rec"),
        F.coalesce("mentions", F.lit(0)).cast("double").alias("imp"),
    )
    span = a.groupBy("dialogue").agg(F.min("rec").alias("r0"), F.max("rec").alias("r1"), F.min("imp").alias("i0"), F.max("imp").alias("i1"))
    scaled = lambda x, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.lit(0.0))
    joined = a.join(span.withColumnRenamed("dialogue", "d"), F.col("dialogue").eqNullSafe(F.col("d")))
    return joined.select("cluster_id", F.round(scaled("rec", "r0", "r1") + scaled("imp", "i0", "i1"), 6).alias("score"))


@add("metadata_score", f"WITH {MEM} SELECT memory_id, round(1e0 / (1e0 + exp(-(-1e0 + 0.05e0 * frequency + 0.2e0 * success_count))), 6) AS score FROM mem")
def metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic score of two counters."""
    z = F.lit(-1.0) + F.lit(0.05) * F.col("frequency") + F.lit(0.2) * F.col("success_count")
    return memories(spark, sf_dir).select("memory_id", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6).alias("score"))


@add(
    "time_to_threshold",
    f"""WITH {COMP}, a AS (SELECT memory_id, 0.2e0 * f + 0.3e0 * u + 0.2e0 * p AS rest FROM comp) SELECT memory_id,
      round(CASE WHEN rest + 0.3e0 <= 0.5e0 THEN 0e0 WHEN rest >= 0.5e0 THEN NULL ELSE -ln((0.5e0 - rest) / 0.3e0) / 0.005e0 END, 6) AS hours FROM a""",
)
def time_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours after an access until a memory falls to 0.5."""
    rest = F.lit(0.2) * F.col("f") + F.lit(0.3) * F.col("u") + F.lit(0.2) * F.col("p")
    return memory.with_components(memories(spark, sf_dir), NOW).select("memory_id", F.round(S.time_to_threshold(rest, 0.3, 0.5), 6).alias("hours"))


@add("mean_score", f"WITH {COMP} SELECT round(coalesce(avg(s), 0e0), 6) AS mean_s, coalesce(max(s), 0e0) AS max_s, count(*)::bigint AS n FROM scored")
def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(
        F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("mean_s"), F.coalesce(F.max("s"), F.lit(0.0)).alias("max_s"), F.count("*").alias("n")
    )


@add(
    "lifecycle_table",
    """WITH g AS (SELECT l.x AS decay, p.x AS p, k.k FROM (VALUES (0.001e0), (0.005e0), (0.01e0)) l(x), (VALUES (0e0), (0.5e0), (1e0)) p(x), range(0, 21) k(k))
    SELECT decay, p, k::bigint AS k, round(greatest(0e0, least(1e0, 0.3e0 + 0.2e0 * least(ln(1e0 + k) / ln(51e0), 1e0) + 0.3e0 * (k + 1e0) / (k + 2e0) + 0.2e0 * p)), 6) AS s0,
      round(ln(2e0) / decay, 6) AS half_life FROM g""",
)
def lifecycle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score at an access after k successes, by decay and P."""
    grid = spark.range(21).select(F.col("id").alias("k"), F.explode(F.array(*map(F.lit, (0.001, 0.005, 0.01)))).alias("decay"))
    grid = grid.select("k", "decay", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0)))).alias("p"))
    s0 = S.composite(F.lit(1.0), S.frequency(F.col("k").cast("double")), S.utility(F.col("k").cast("double"), F.lit(0.0)), F.col("p"))
    return grid.select("decay", "p", "k", s0.alias("s0"), F.round(F.log(F.lit(2.0)) / F.col("decay"), 6).alias("half_life"))


@add(
    "min_successes",
    """WITH g AS (SELECT p.x AS p, k.k, round(greatest(0e0, least(1e0, 0.3e0 + 0.2e0 * least(ln(1e0 + k) / ln(51e0), 1e0) + 0.3e0 * (k + 1e0) / (k + 2e0) + 0.2e0 * p.x)), 6) AS s
      FROM (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) p(x), range(0, 1001) k(k)) SELECT p, (min(k) FILTER (WHERE s > 0.7e0))::bigint AS k FROM g GROUP BY p""",
)
def min_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes that a fresh memory needs to be retained."""
    grid = spark.range(1001).select(F.col("id").alias("k"), F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("p"))
    s = S.composite(F.lit(1.0), S.frequency(F.col("k").cast("double")), S.utility(F.col("k").cast("double"), F.lit(0.0)), F.col("p"))
    return grid.groupBy("p").agg(F.min(F.when(s > S.RETAIN, F.col("k"))).alias("k"))


@add(
    "flip_rates",
    f"""WITH {COMP}, x AS (SELECT lower(trim(source)) AS source, s > 0.55e0 AS yes, u > 0.5e0 AS y FROM scored WHERE trim(source) <> ''),
    c AS (SELECT source, count(*) FILTER (WHERE yes AND y) / nullif(count(*) FILTER (WHERE yes), 0)::double AS precision, count(*) FILTER (WHERE yes AND y) / nullif(count(*) FILTER (WHERE y), 0)::double AS recall, avg(y::int) AS base FROM x GROUP BY source)
    SELECT source, round(1 - recall, 6) AS miss_rate, round(CASE WHEN precision > 0 AND base < 1 THEN base * recall * (1 / precision - 1) / (1 - base) END, 6) AS false_rate FROM c""",
)
def flip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of the verdicts by writer, from their precision and recall at the base rate."""
    x = scored(spark, sf_dir).where(F.trim("source") != "").select(F.lower(F.trim("source")).alias("source"), (F.col("s") > 0.55).alias("yes"), (F.col("u") > 0.5).alias("y"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = x.groupBy("source").agg(n(F.col("yes") & F.col("y")).alias("tp"), n(F.col("yes")).alias("yes"), n(F.col("y")).alias("pos"), F.avg(F.col("y").cast("int")).alias("base"))
    g = g.select("source", "base", (F.col("tp") / F.nullif(F.col("yes"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"))
    false = F.when((F.col("precision") > 0) & (F.col("base") < 1), F.col("base") * F.col("recall") * (F.lit(1.0) / F.col("precision") - 1) / (F.lit(1.0) - F.col("base")))
    return g.select("source", F.round(F.lit(1.0) - F.col("recall"), 6).alias("miss_rate"), F.round(false, 6).alias("false_rate"))


@add(
    "mass_ratio",
    f"""WITH {COMP}, t AS (SELECT collection, s, row_number() OVER (PARTITION BY collection ORDER BY s DESC, memory_id) AS rn FROM scored)
    SELECT collection, round(avg(s) FILTER (WHERE rn <= 5) / greatest(1e-6, avg(s)), 6) AS ratio FROM t GROUP BY collection""",
)
def mass_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of a collection's best five over that of all its memories."""
    s = scored(spark, sf_dir).select("collection", "memory_id", "s")
    w = Window.partitionBy("collection").orderBy(F.desc("s"), "memory_id")
    best = s.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("collection").agg(F.avg("s").alias("top"))
    all_ = s.groupBy("collection").agg(F.avg("s").alias("mean"))
    joined = all_.withColumnRenamed("collection", "c").join(best, F.col("c").eqNullSafe(F.col("collection")))
    return joined.select("collection", F.round(F.col("top") / F.greatest(F.lit(1e-6), F.col("mean")), 6).alias("ratio"))


@add("matched_rate", "SELECT doc_id, greatest(0.05e0, least(0.95e0, 200e0 / n_tokens)) AS rate FROM documents WHERE n_tokens > 0")
def matched_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.lit(200.0) / F.col("n_tokens")))
    return table(spark, sf_dir, "documents").where("n_tokens > 0").select("doc_id", rate.alias("rate"))
