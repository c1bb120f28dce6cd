"""Aggregates, agreement, rank statistics and parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.functions import score as S
from retentia.operators import rank, resample, stats
from retentia.plans.common import CAND, COMP, MEM, NOW, RRF, TOPIC_SQL, candidates, memories, scored, sql_rerank, topic
from retentia.plans.registry import Registry
from retentia.sources.tables import table

registry = Registry()
add = registry.add


@add("metric_summary", f"WITH {COMP} SELECT 's' AS metric, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count(s)::bigint AS n FROM scored UNION ALL SELECT 'u', round(avg(u), 6), round(stddev_pop(u), 6), count(u)::bigint FROM scored UNION ALL SELECT 'r', round(avg(r), 6), round(stddev_pop(r), 6), count(r)::bigint FROM scored")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation and count of each metric."""
    long = scored(spark, sf_dir).select("memory_id", *"sur").unpivot("memory_id", list("sur"), "metric", "x")
    return long.groupBy("metric").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.count("x").alias("n"))


_TYPE = TOPIC_SQL


@add("type_separation", f"WITH {COMP} SELECT {_TYPE} AS type, count(*)::bigint AS n, round(avg(s), 6) AS mean_s, round(min(s), 6) AS low, round(max(s), 6) AS high FROM scored GROUP BY 1")
def type_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the type that a tag names."""
    return scored(spark, sf_dir).groupBy(topic().alias("type")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_s"), F.min("s").alias("low"), F.max("s").alias("high"))


_TIERS = "CASE WHEN s > 0.7e0 THEN 'retain' WHEN s > 0.3e0 THEN 'compress' ELSE 'delete' END"


@add(
    "retention_matrix",
    f"""WITH {COMP}, t AS (SELECT {_TYPE} AS type, {_TIERS} AS tier FROM scored) SELECT type, count(*) FILTER (WHERE tier = 'retain')::bigint AS retain, count(*) FILTER (WHERE tier = 'compress')::bigint AS compress,
    count(*) FILTER (WHERE tier = 'delete')::bigint AS "delete" FROM t GROUP BY type""",
)
def retention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by tier counts (pivot with fixed columns)."""
    t = scored(spark, sf_dir).select(topic().alias("type"), S.tier(F.col("s")).alias("tier"))
    return t.groupBy("type").pivot("tier", ["retain", "compress", "delete"]).count().na.fill(0)


#: Shifts of the upper bound, the lower bound and both.
SHIFTS = [(name, d if name != "compress" else 0.0, d if name != "retain" else 0.0) for name in ("retain", "compress", "both") for d in (-0.1, -0.05, 0.05, 0.1)]
_SHIFTS = ", ".join(f"('{n}', {a}e0, {b}e0)" for n, a, b in SHIFTS)


@add(
    "shift_stability",
    f"""WITH {COMP}, d AS (SELECT * FROM (VALUES {_SHIFTS}) t(moved, up, low)), x AS (SELECT moved, up, low, {_TIERS} AS a, CASE WHEN s > 0.7e0 + up THEN 'retain' WHEN s > 0.3e0 + low THEN 'compress' ELSE 'delete' END AS b FROM scored, d),
    c AS (SELECT moved, up, low, a, b, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT moved, up, low, sum(n)::double AS t, sum(n) FILTER (WHERE a = b) / sum(n)::double AS po, sum(n) FILTER (WHERE b = 'retain') AS r, sum(n) FILTER (WHERE b = 'compress') AS c FROM c GROUP BY ALL),
    e AS (SELECT moved, up, low, sum(p * q) AS pe FROM (SELECT moved, up, low, a AS k, sum(n) AS p FROM c GROUP BY ALL) JOIN (SELECT moved, up, low, b AS k, sum(n) AS q FROM c GROUP BY ALL) USING (moved, up, low, k) GROUP BY ALL)
    SELECT moved, up, low, round(1 - coalesce(po, 0e0), 6) AS changed, round(coalesce(r, 0) / t, 6) AS retain, round(coalesce(c, 0) / t, 6) AS compress, round(CASE WHEN pe >= t * t THEN 1e0 ELSE (coalesce(po, 0e0) - coalesce(pe, 0) / (t * t)) / (1 - coalesce(pe, 0) / (t * t)) END, 6) AS kappa
    FROM t LEFT JOIN e USING (moved, up, low)""",
)
def shift_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier shares, changed share and kappa under twelve shifts of the bounds; rows meet as counts of tier pairs."""
    each = F.array(*(F.struct(F.lit(n).alias("moved"), F.lit(a).alias("up"), F.lit(b).alias("low")) for n, a, b in SHIFTS))
    m = scored(spark, sf_dir).select("s", F.explode(each).alias("d")).select("s", "d.*")
    b = F.when(F.col("s") > F.lit(0.7) + F.col("up"), "retain").when(F.col("s") > F.lit(0.3) + F.col("low"), "compress").otherwise("delete")
    key = ["moved", "up", "low"]
    cells = m.groupBy(*key, S.tier(F.col("s")).alias("a"), b.alias("b")).agg(F.count("*").alias("n"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    tiers = ("retain", "compress", "delete")
    sums = {f"{x}_{t}": n(F.col(x) == t) for x in "ab" for t in tiers} | {"t": F.sum("n"), "same": n(F.col("a") == F.col("b"))}
    g = cells.groupBy(*key).agg(*(c.alias(name) for name, c in sums.items()))
    t = F.col("t").cast("double")
    pe = sum((F.col(f"a_{x}") * F.col(f"b_{x}") for x in tiers), F.lit(0)) / (t * t)
    po = F.col("same") / t
    kappa = F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))
    return g.select(*key, F.round(1 - po, 6).alias("changed"), F.round(F.col("b_retain") / t, 6).alias("retain"), F.round(F.col("b_compress") / t, 6).alias("compress"), F.round(kappa, 6).alias("kappa"))


@add(
    "grouped_summary",
    f"""WITH {COMP}, x AS (SELECT lower(trim(source)) AS source, unnest(['s', 'f', 'p']) AS metric, unnest([s, f, p]) AS v FROM scored WHERE trim(source) <> '')
    SELECT source, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, count(*)::bigint AS n FROM x GROUP BY source, metric""",
)
def grouped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by group, wide to long first."""
    m = scored(spark, sf_dir).where(F.trim("source") != "").select(F.lower(F.trim("source")).alias("source"), "memory_id", *"sfp")
    long = m.unpivot(["source", "memory_id"], list("sfp"), "metric", "v")
    return long.groupBy("source", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", 0.5), 6).alias("median"), F.count("*").alias("n"))


@add(
    "latency_median",
    """WITH d AS (SELECT batch_id, (epoch_us(received_at) - epoch_us(collected_at)) / 1e6 AS lag FROM collected_requests)
    SELECT batch_id, round(quantile_cont(lag, 0.5), 3) AS p50, round(quantile_cont(lag, 0.95), 3) AS p95, count(*)::bigint AS n FROM d GROUP BY batch_id""",
)
def latency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of the delivery lag by batch, interpolated."""
    lag = (F.unix_micros("received_at") - F.unix_micros("collected_at")) / 1e6
    g = table(spark, sf_dir, "collected_requests").select("batch_id", lag.alias("lag")).groupBy("batch_id")
    return g.agg(F.round(F.percentile("lag", 0.5), 3).alias("p50"), F.round(F.percentile("lag", 0.95), 3).alias("p95"), F.count("*").alias("n"))


@add(
    "needed_composition",
    f"""WITH {COMP}
    SELECT frequency >= 2 AS needed, count(*)::bigint AS n, round(avg((lower(trim(source)) = 'user')::int), 6) AS user_share, round(quantile_cont({NOW}e0 - created_ts, 0.5), 3) AS median_age FROM scored GROUP BY 1""",
)
def needed_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote, and how old are, the memories that were used twice or more, against the rest."""
    m = scored(spark, sf_dir).withColumn("needed", F.col("frequency") >= 2)
    return m.groupBy("needed").agg(
        F.count("*").alias("n"), F.round(F.avg((F.lower(F.trim("source")) == "user").cast("int")), 6).alias("user_share"),
        F.round(F.percentile(F.lit(NOW) - F.col("created_ts"), 0.5), 3).alias("median_age"),
    )


@add(
    "need_persistence",
    """WITH s AS (SELECT DISTINCT dialogue, unnest(sessions) AS session, cluster_id FROM fact_clusters WHERE dialogue IS NOT NULL), x AS (SELECT *, min(session) OVER (PARTITION BY dialogue, cluster_id) AS first, count(*) OVER (PARTITION BY dialogue, cluster_id) AS n FROM s)
    SELECT session::int AS session, count(*)::bigint AS n, round(avg((session > first)::int), 6) AS before, round(avg((n > 1)::int), 6) AS repeated FROM x GROUP BY session""",
)
def need_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By session, the share of facts met before and of facts met more than once."""
    s = table(spark, sf_dir, "fact_clusters").where("dialogue IS NOT NULL").select("dialogue", "cluster_id", F.explode("sessions").alias("session")).distinct()
    own = s.groupBy("dialogue", "cluster_id").agg(F.min("session").alias("first"), F.count("*").alias("n"))
    x = s.join(own, ["dialogue", "cluster_id"]).select("session", (F.col("session") > F.col("first")).cast("int").alias("b"), (F.col("n") > 1).cast("int").alias("r"))
    return x.groupBy("session").agg(F.count("*").alias("n"), F.round(F.avg("b"), 6).alias("before"), F.round(F.avg("r"), 6).alias("repeated"))


@add("distinct_texts", "SELECT text, min(unit_id)::bigint AS first FROM memory_units WHERE text IS NOT NULL GROUP BY text")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memory_units").where("text IS NOT NULL").groupBy("text").agg(F.min("unit_id").alias("first"))


@add(
    "count_prior",
    "SELECT regexp_extract(text_content, 'The [a-z]+ ([a-z ]+) labelled', 1) AS obj, regexp_extract(text_content, 'was on ([a-z ]+) [0-9]+', 1) AS place, count(*)::bigint AS n FROM memory_points WHERE regexp_matches(text_content, 'labelled .* was on [a-z ]+ [0-9]+') GROUP BY 1, 2",
)
def count_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each object was seen in each place."""
    m = table(spark, sf_dir, "memory_points").where(F.col("text_content").rlike("labelled .* was on [a-z ]+ [0-9]+"))
    obj, place = F.regexp_extract("text_content", "The [a-z]+ ([a-z ]+) labelled", 1), F.regexp_extract("text_content", "was on ([a-z ]+) [0-9]+", 1)
    return m.groupBy(obj.alias("obj"), place.alias("place")).agg(F.count("*").alias("n"))


@add("label_coverage", "SELECT source, count(*)::bigint AS n, round(avg((len(units) > 0 AND len(questions) > 0)::int), 6) AS covered FROM contexts GROUP BY source")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of contexts with units and questions."""
    both = (F.size("units") > 0) & (F.size("questions") > 0)
    known = F.col("units").isNotNull() & F.col("questions").isNotNull()
    return table(spark, sf_dir, "contexts").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(known, both.cast("int"))), 6).alias("covered"))


_MODEL = "regexp_extract(body, '\"model\": ?\"([a-z-]+)\"', 1)"


@add("usage_ledger", f"SELECT {_MODEL} AS model, count(*)::bigint AS n, sum(length(body) // 3 + 4)::bigint AS tokens FROM collected_requests WHERE body IS NOT NULL GROUP BY 1")
def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and estimated tokens by model."""
    model = F.regexp_extract("body", '"model": ?"([a-z-]+)"', 1)
    tokens = F.sum(F.floor(F.length("body") / 3) + 4)
    return table(spark, sf_dir, "collected_requests").where("body IS NOT NULL").groupBy(model.alias("model")).agg(F.count("*").alias("n"), tokens.alias("tokens"))


@add(
    "usage_rollup",
    f"SELECT {_MODEL} AS model, method, grouping({_MODEL})::int AS all_models, grouping(method)::int AS all_methods, count(*)::bigint AS n FROM collected_requests WHERE body IS NOT NULL GROUP BY ROLLUP ({_MODEL}, method)",
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by model and method with totals."""
    r = table(spark, sf_dir, "collected_requests").where("body IS NOT NULL").select(F.regexp_extract("body", '"model": ?"([a-z-]+)"', 1).alias("model"), "method")
    g = r.rollup("model", "method").agg(F.grouping("model").cast("int").alias("all_models"), F.grouping("method").cast("int").alias("all_methods"), F.count("*").alias("n"))
    return g.select("model", "method", "all_models", "all_methods", "n")


_IR = f"""{sql_rerank(RRF)}, ir AS (SELECT qid, pos, (lower(trim(source)) = 'agent')::int AS hit, s FROM final)"""


def _ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce((F.lower(F.trim("source")) == "agent").cast("int"), F.lit(0))
    return rank.rerank(candidates(spark, sf_dir), "rrf").select("qid", "pos", hit.alias("hit"), "s")


@add(
    "ir_macro",
    f"""WITH {_IR}, q2 AS (SELECT qid, sum(coalesce(hit, 0)) FILTER (WHERE pos <= 5) AS h5, sum(coalesce(hit, 0)) AS n, min(pos) FILTER (WHERE hit = 1) AS first FROM ir GROUP BY qid)
    SELECT count(*)::bigint AS queries, round(avg(h5 / 5e0), 6) AS precision, round(avg(CASE WHEN n > 0 THEN h5 / n END), 6) AS recall, round(avg(coalesce(1e0 / first, 0e0)), 6) AS mrr, round(avg((h5 > 0)::int), 6) AS hit,
      round(avg(CASE WHEN n > 0 THEN h5 / least(5, n) END), 6) AS capped FROM q2""",
)
def ir_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro precision, recall, MRR, hit rate and capped recall at five."""
    five = F.sum(F.when(F.col("pos") <= 5, F.col("hit")).otherwise(0))
    q = _ir(spark, sf_dir).groupBy("qid").agg(five.alias("h5"), F.sum("hit").alias("n"), F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first"))
    return q.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col("h5") / 5.0), 6).alias("precision"), F.round(F.avg(F.when(F.col("n") > 0, F.col("h5") / F.col("n"))), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.col("h5") > 0).cast("int")), 6).alias("hit"),
        F.round(F.avg(F.when(F.col("n") > 0, F.col("h5") / F.least(F.lit(5), F.col("n")))), 6).alias("capped"),
    )


@add(
    "frequency_bias",
    f"WITH {COMP} SELECT round(avg(s) FILTER (WHERE frequency >= 5), 6) AS high, round(avg(s) FILTER (WHERE frequency < 5), 6) AS low, round(avg(s) FILTER (WHERE frequency >= 5) / nullif(avg(s) FILTER (WHERE frequency < 5), 0), 6) AS ratio FROM scored",
)
def frequency_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of often and of seldom used memories, and their ratio."""
    high, low = F.avg(F.when(F.col("frequency") >= 5, F.col("s"))), F.avg(F.when(F.col("frequency") < 5, F.col("s")))
    return scored(spark, sf_dir).agg(high.alias("h"), low.alias("l")).select(F.round("h", 6).alias("high"), F.round("l", 6).alias("low"), F.round(F.col("h") / F.nullif(F.col("l"), F.lit(0.0)), 6).alias("ratio"))


@add("cooling_delta", f"WITH {_IR}, d AS (SELECT qid, avg(s) FILTER (WHERE hit = 1) - avg(s) FILTER (WHERE coalesce(hit, 0) = 0) AS d FROM ir GROUP BY qid) SELECT round(avg(d), 6) AS delta, count(d)::bigint AS n FROM d")
def cooling_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over queries of the score gap between relevant and other candidates."""
    d = _ir(spark, sf_dir).groupBy("qid").agg((F.avg(F.when(F.col("hit") == 1, F.col("s"))) - F.avg(F.when(F.col("hit") == 0, F.col("s")))).alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("delta"), F.count("d").alias("n"))


@add("novelty_rate", f"WITH {CAND}, m AS (SELECT qid, max(sim) AS best FROM top GROUP BY qid) SELECT count(*)::bigint AS n, round(avg((best < 0.4e0)::int), 6) AS novel, round(avg((best >= 0.3e0)::int), 6) AS retrievable FROM m")
def novelty_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries without a near memory, and with one near enough to be retrieved."""
    m = candidates(spark, sf_dir).groupBy("qid").agg(F.max("sim").alias("best"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg((F.col("best") < 0.4).cast("int")), 6).alias("novel"), F.round(F.avg((F.col("best") >= 0.3).cast("int")), 6).alias("retrievable"))


@add("negative_control", f"WITH {CAND}, m AS (SELECT qid, max(sim) AS best FROM top WHERE sim_rank <= 5 GROUP BY qid) SELECT round(avg((best >= 0.8e0)::int), 6) AS false_hits FROM m")
def negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = candidates(spark, sf_dir).where("sim_rank <= 5").groupBy("qid").agg(F.max("sim").alias("best"))
    return m.agg(F.round(F.avg((F.col("best") >= 0.8).cast("int")), 6).alias("false_hits"))


@add(
    "centroid",
    """WITH e AS (SELECT label, unnest(embedding::double[]) AS x, unnest(range(0, 64)) AS dim FROM embeddings) SELECT label, dim::int AS dim, round(avg(x), 6) AS x FROM e GROUP BY label, dim""",
)
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector by label, one row a dimension; partial sums meet before the shuffle."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


# Agreement and rank statistics


_MC = """x AS (SELECT s > 0.5e0 AS a, u > 0.5e0 AS b FROM scored), c AS (SELECT count(*) FILTER (WHERE a AND NOT b)::bigint AS a_only, count(*) FILTER (WHERE b AND NOT a)::bigint AS b_only, count(*) FILTER (WHERE a = b)::bigint AS same FROM x)"""


@add(
    "mcnemar_exact",
    f"""WITH {COMP}, {_MC} SELECT a_only, b_only, same, round(CASE WHEN a_only + b_only = 0 THEN 1e0 ELSE least(1e0, 2e0 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
      lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2e0))))) END, 6) AS p FROM c""",
)
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs of two classifiers and the exact two-sided p."""
    m = scored(spark, sf_dir).select((F.col("s") > 0.5).alias("a"), (F.col("u") > 0.5).alias("b"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = m.agg(n(F.col("a") & ~F.col("b")).alias("a_only"), n(F.col("b") & ~F.col("a")).alias("b_only"), n(F.col("a") == F.col("b")).alias("same"))
    return c.withColumn("p", F.round(stats.mcnemar_p(F.col("a_only"), F.col("b_only")), 6))


@add(
    "holm",
    f"""WITH {COMP}, p AS (SELECT collection AS family, {TOPIC_SQL} AS test, round(1 - max(s), 6) AS p FROM scored WHERE collection IS NOT NULL GROUP BY 1, 2),
    q AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS q FROM p)
    SELECT family, test, p, round(max(q) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM q""",
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjustment within families; here 1 - best score of each topic stands for a p value in its collection."""
    p = scored(spark, sf_dir).where("collection IS NOT NULL").groupBy(F.col("collection").alias("family"), topic().alias("test")).agg(F.round(1 - F.max("s"), 6).alias("p"))
    return stats.holm(p, "test", "p", "family")


def _kappa_sql(a: str, b: str) -> str:
    return f"""WITH {COMP}, x AS (SELECT {a} AS a, {b} AS b FROM scored), n AS (SELECT count(*) AS n, avg((a = b)::int) AS po FROM x),
    e AS (SELECT sum(p * q) AS pe FROM (SELECT a, count(*) / (SELECT n FROM n)::double AS p FROM x GROUP BY a) JOIN (SELECT b AS a, count(*) / (SELECT n FROM n)::double AS q FROM x GROUP BY b) USING (a))
    SELECT round(CASE WHEN pe >= 1 THEN 1e0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa, n::bigint AS n FROM n, e"""


@add("kappa_binary", _kappa_sql("s > 0.5e0", "u > 0.5e0"))
def kappa_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kappa(scored(spark, sf_dir).select((F.col("s") > 0.5).alias("a"), (F.col("u") > 0.5).alias("b")), "a", "b")


@add("kappa_multi", _kappa_sql(_TIERS, _TIERS.replace("s >", "u >")))
def kappa_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kappa(scored(spark, sf_dir).select(S.tier(F.col("s")).alias("a"), S.tier(F.col("u")).alias("b")), "a", "b")


@add("midrank", f"WITH {MEM} SELECT memory_id, rank() OVER (PARTITION BY collection ORDER BY frequency) + (count(*) OVER (PARTITION BY collection, frequency) - 1) / 2e0 AS midrank FROM mem WHERE collection IS NOT NULL")
def midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of frequencies within a collection."""
    m = memories(spark, sf_dir).where("collection IS NOT NULL").select("memory_id", "collection", "frequency")
    return stats.midranks(m, "frequency", ["collection"]).select("memory_id", "midrank")


def _auroc_sql(score: str, group: str) -> str:
    return f"""x AS (SELECT {group} AS g, {score} AS v, frequency >= 2 AS y FROM scored), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2e0 AS mr FROM x),
    a AS (SELECT g, round((sum(mr) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2e0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS auc,
      count(*) FILTER (WHERE y)::bigint AS n_pos, count(*) FILTER (WHERE NOT y)::bigint AS n_neg FROM r GROUP BY g)"""


@add("auroc", f"WITH {COMP}, {_auroc_sql('u', 'collection')} SELECT g AS collection, CASE WHEN n_pos > 0 AND n_neg > 0 THEN auc END AS auc, n_pos, n_neg FROM a")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well utility tells memories used twice or more, by collection."""
    m = scored(spark, sf_dir).select("collection", F.col("u"), (F.col("frequency") >= 2).alias("y"))
    return stats.auroc(m, "u", "y", ["collection"])


GRID = "g AS (SELECT a / 10e0 AS wr, b / 10e0 AS wf, c / 10e0 AS wu, (10 - a - b - c) / 10e0 AS wp FROM range(0, 11) x(a), range(0, 11) y(b), range(0, 11) z(c) WHERE a + b + c <= 10)"


def simplex(spark: SparkSession, steps: int = 10) -> DataFrame:
    """(wr, wf, wu, wp): all weights in steps of 1 / `steps` that sum to 1."""
    r = lambda name: spark.range(steps + 1).withColumnRenamed("id", name)
    g = r("a").join(r("b"), F.col("a") + F.col("b") <= steps).join(r("c"), F.col("a") + F.col("b") + F.col("c") <= steps)
    part = lambda c: (c / float(steps)).cast("double")
    return g.select(part(F.col("a")).alias("wr"), part(F.col("b")).alias("wf"), part(F.col("c")).alias("wu"), part(F.lit(steps) - F.col("a") - F.col("b") - F.col("c")).alias("wp"))


@add("simplex_grid", f"WITH {GRID} SELECT * FROM g")
def simplex_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex(spark)


WHOLE_GRID = f"""WITH {COMP}, {GRID}, x AS (SELECT wr, wf, wu, wp, round(wr * r + wf * f + wu * u + wp * p, 6) AS v, frequency >= 2 AS y FROM scored, g),
    k AS (SELECT *, rank() OVER (PARTITION BY wr, wf, wu, wp ORDER BY v) + (count(*) OVER (PARTITION BY wr, wf, wu, wp, v) - 1) / 2e0 AS mr FROM x WHERE y IS NOT NULL),
    t AS (SELECT wr, wf, wu, wp, (sum(mr) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2e0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) AS auc FROM k GROUP BY ALL)"""


def _auroc_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wr, wf, wu, wp, auc) of all 286 weightings, auc not rounded."""
    grid = [tuple(g) for g in simplex(spark).select("wr", "wf", "wu", "wp").collect()]
    m = scored(spark, sf_dir).select("r", "f", "u", "p", (F.col("frequency") >= 2).alias("y"))
    return stats.auroc_of_weights(m, ["r", "f", "u", "p"], "y", ["wr", "wf", "wu", "wp"], [(g, g) for g in grid]).drop("n_pos", "n_neg")


@add("auroc_grid", f"{WHOLE_GRID} SELECT wr, wf, wu, wp, round(auc, 6) AS auc FROM t")
def auroc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of every weighting of the grid."""
    return _auroc_of_grid(spark, sf_dir).withColumn("auc", F.round("auc", 6))


def best_config(t: DataFrame) -> DataFrame:
    """The weighting of the highest AUROC before rounding; within 1e-12 the one closest to the default, then in order."""
    l1 = F.round(F.abs(F.col("wr") - 0.3) + F.abs(F.col("wf") - 0.2) + F.abs(F.col("wu") - 0.3) + F.abs(F.col("wp") - 0.2), 9)
    rows = t.withColumn("best", F.max("auc").over(Window.partitionBy())).where(F.col("auc") > F.col("best") - 1e-12)
    return rows.orderBy(l1, "wr", "wf", "wu", "wp").limit(1).select("wr", "wf", "wu", "wp", F.round("auc", 6).alias("auc"))


@add(
    "select_config",
    f"""{WHOLE_GRID}, z AS (SELECT *, abs(wr - 0.3e0) + abs(wf - 0.2e0) + abs(wu - 0.3e0) + abs(wp - 0.2e0) AS l1, max(auc) OVER () AS best FROM t)
    SELECT wr, wf, wu, wp, round(auc, 6) AS auc FROM z WHERE auc > best - 1e-12 ORDER BY round(l1, 9), wr, wf, wu, wp LIMIT 1""",
)
def select_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best weighting; of equals the one closest to the default, then in order."""
    return best_config(_auroc_of_grid(spark, sf_dir))


@add("top10_configs", f"{WHOLE_GRID} SELECT wr, wf, wu, wp, round(auc, 6) AS auc FROM t ORDER BY round(auc, 6) DESC, wr, wf, wu, wp LIMIT 10")
def top10_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auroc_grid(spark, sf_dir).orderBy(F.desc("auc"), "wr", "wf", "wu", "wp").limit(10)


@add(
    "delong_auc",
    f"""WITH {COMP}, x AS (SELECT u AS v, frequency >= 2 AS y FROM scored), t AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS tz, rank() OVER (PARTITION BY y ORDER BY v) + (count(*) OVER (PARTITION BY y, v) - 1) / 2e0 AS tc FROM x),
    n AS (SELECT count(*) FILTER (WHERE y)::double AS m, count(*) FILTER (WHERE NOT y)::double AS k FROM x),
    d AS (SELECT (sum(tz) FILTER (WHERE y) / any_value(m) - (any_value(m) + 1) / 2e0) / any_value(k) AS auc,
      sqrt(var_samp((tz - tc) / k) FILTER (WHERE y) / any_value(m) + var_samp(1 - (tz - tc) / m) FILTER (WHERE NOT y) / any_value(k)) AS se FROM t, n)
    SELECT round(auc, 6) AS auc, round(se, 6) AS se, round(auc - 1.959964e0 * se, 6) AS low, round(auc + 1.959964e0 * se, 6) AS high FROM d""",
)
def delong_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of utility over all memories, its DeLong standard error and 95 % interval."""
    x = scored(spark, sf_dir).select("memory_id", F.col("u").alias("v"), (F.col("frequency") >= 2).alias("y")).withColumn("all", F.lit(1))
    t = stats.midranks(x, "v", ["all"]).withColumnRenamed("midrank", "tz")
    t = stats.midranks(t, "v", ["y"]).withColumnRenamed("midrank", "tc")
    n = x.agg(F.sum(F.col("y").cast("int")).cast("double").alias("m"), F.sum((~F.col("y")).cast("int")).cast("double").alias("k"))
    t = t.crossJoin(F.broadcast(n))
    pos = lambda c: F.when(F.col("y"), c)
    gap = F.col("tz") - F.col("tc")
    g = t.groupBy("m", "k").agg(F.sum(pos(F.col("tz"))).alias("s"), F.var_samp(pos(gap / F.col("k"))).alias("v1"), F.var_samp(F.when(~F.col("y"), 1 - gap / F.col("m"))).alias("v0"))
    auc = (F.col("s") / F.col("m") - (F.col("m") + 1) / 2.0) / F.col("k")
    g = g.select(auc.alias("auc"), F.sqrt(F.col("v1") / F.col("m") + F.col("v0") / F.col("k")).alias("se"))
    ends = {"auc": F.col("auc"), "se": F.col("se"), "low": F.col("auc") - 1.959964 * F.col("se"), "high": F.col("auc") + 1.959964 * F.col("se")}
    return g.select(*(F.round(c, 6).alias(name) for name, c in ends.items()))


@add(
    "judge_agreement",
    f"""WITH {COMP}, x AS (SELECT lower(trim(source)) AS source, CASE WHEN s > 0.55e0 THEN 'YES' WHEN s < 0.4e0 THEN 'NO' ELSE 'NEUTRAL' END AS v, u > 0.5e0 AS y FROM scored WHERE trim(source) <> '')
    SELECT source, count(*)::bigint AS n, round(avg((v = 'NEUTRAL')::int), 6) AS neutral, round(count(*) FILTER (WHERE v = 'YES' AND y) / nullif(count(*) FILTER (WHERE v = 'YES'), 0)::double, 6) AS precision,
      round(count(*) FILTER (WHERE v = 'YES' AND y) / nullif(count(*) FILTER (WHERE y), 0)::double, 6) AS recall FROM x GROUP BY source""",
)
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts against outcomes by writer."""
    v = F.when(F.col("s") > 0.55, "YES").when(F.col("s") < 0.4, "NO").otherwise("NEUTRAL")
    x = scored(spark, sf_dir).where(F.trim("source") != "").select(F.lower(F.trim("source")).alias("source"), v.alias("v"), (F.col("u") > 0.5).alias("y"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    yes, y = F.col("v") == "YES", F.col("y")
    g = x.groupBy("source").agg(F.count("*").alias("n"), n(F.col("v") == "NEUTRAL").alias("z"), n(yes & y).alias("tp"), n(yes).alias("yes"), n(y).alias("pos"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return g.select("source", "n", ratio("z", "n").alias("neutral"), ratio("tp", "yes").alias("precision"), ratio("tp", "pos").alias("recall"))


@add(
    "curve_crossing",
    f"""WITH {COMP}, n AS (SELECT count(*)::double AS n FROM scored), h AS (SELECT least(floor(s * 20), 19)::int AS b, count(*) AS k FROM scored GROUP BY 1),
    c AS (SELECT b.b / 20e0 AS x, coalesce((SELECT sum(k) FROM h WHERE h.b >= b.b), 0) / n AS y FROM range(0, 21) b(b), n), l AS (SELECT x, y, lag(x) OVER (ORDER BY x) AS x0, lag(y) OVER (ORDER BY x) AS y0 FROM c)
    SELECT round(x0 + (y0 - 0.5e0) / (y0 - y) * (x - x0), 6) AS crossing FROM l WHERE y < 0.5e0 ORDER BY x LIMIT 1""",
)
def curve_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score above which half of the memories lie, by linear interpolation on the falling curve of twenty-one points."""
    h = scored(spark, sf_dir).groupBy(F.least(F.floor(F.col("s") * 20), F.lit(19)).cast("int").alias("b")).agg(F.count("*").alias("k"))
    grid = spark.range(21).select(F.col("id").cast("int").alias("b")).join(h, "b", "left")  # twenty-one rows from here on
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    c = grid.select((F.col("b") / 20.0).alias("x"), (above / F.sum("k").over(Window.partitionBy())).alias("y"))
    w = Window.orderBy("x")
    lagged = c.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)}).where("y < 0.5").orderBy("x").limit(1)
    return lagged.select(F.round(F.col("x0") + (F.col("y0") - 0.5) / (F.col("y0") - F.col("y")) * (F.col("x") - F.col("x0")), 6).alias("crossing"))


@add(
    "transfer_matrix",
    f"""WITH {COMP}, g AS (SELECT * FROM (VALUES ('default', 0.3e0, 0.2e0, 0.3e0, 0.2e0), ('recency', 1e0, 0e0, 0e0, 0e0), ('use', 0e0, 0.5e0, 0.5e0, 0e0)) t(config, wr, wf, wu, wp)),
    x AS (SELECT config, lower(trim(source)) AS source, round(wr * r + wf * f + wu * u + wp * p, 6) AS v FROM scored, g WHERE trim(source) <> '')
    SELECT config, source, round(avg(v), 6) AS mean, round(avg((v > 0.5e0)::int), 6) AS above FROM x GROUP BY config, source""",
)
def transfer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration applied to each writer's memories."""
    configs = {"default": (0.3, 0.2, 0.3, 0.2), "recency": (1.0, 0.0, 0.0, 0.0), "use": (0.0, 0.5, 0.5, 0.0)}
    each = F.array(*(F.struct(F.lit(k).alias("config"), F.round(sum(F.lit(a) * F.col(c) for a, c in zip(w, "rfup")), 6).alias("v")) for k, w in configs.items()))
    x = scored(spark, sf_dir).where(F.trim("source") != "").select(F.lower(F.trim("source")).alias("source"), F.explode(each).alias("e")).select("source", "e.*")
    return x.groupBy("config", "source").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg((F.col("v") > 0.5).cast("int")), 6).alias("above"))


@add("age_percentile", f"WITH {MEM} SELECT collection, memory_id, round(percent_rank() OVER (PARTITION BY collection ORDER BY created_ts, memory_id), 6) AS pct FROM mem WHERE collection IS NOT NULL")
def age_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a collection's other memories that are older, ties in the order of ids."""
    m = memories(spark, sf_dir).where("collection IS NOT NULL").select("collection", "memory_id", "created_ts")
    m = rank.rank_within(m, ["collection"], "created_ts", "memory_id")
    pct = F.when(F.col("n") > 1, (F.col("place") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return m.select("collection", "memory_id", F.round(pct, 6).alias("pct"))


@add("boot_point", f"WITH {COMP} SELECT round(avg(s), 6) AS mean, count(*)::bigint AS n FROM scored")
def boot_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point estimate that boot_mean puts an interval around."""
    return scored(spark, sf_dir).agg(F.round(F.avg("s"), 6).alias("mean"), F.count("*").alias("n"))


#: Replicates of means, agreement and AUROC (fixed values), and the seed of all of them.
REPLICATES, AUROC_REPLICATES, SEED = 10_000, 2_000, 7


@add("boot_mean")
def boot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score with a 95 % percentile interval of the two-stage bootstrap over collections and their memories."""
    b = resample.mean_replicates(scored(spark, sf_dir), "collection", "s", REPLICATES, SEED)
    return b.agg(F.round(F.avg("mean"), 6).alias("mean"), *resample.interval(b, "mean"), F.count("*").alias("replicates"))


@add("boot_difference")
def boot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired difference of score and utility: interval, two-sided p and the p of being worse than a margin of 0.05."""
    d = scored(spark, sf_dir).select("collection", F.round(F.col("s") - F.col("u"), 9).alias("d"))
    b = resample.mean_replicates(d, "collection", "d", REPLICATES, SEED)
    worse = F.avg((F.col("mean") <= -0.05).cast("int"))
    return b.agg(F.round(F.avg("mean"), 6).alias("diff"), *resample.interval(b, "mean"), F.round(resample.two_sided("mean"), 6).alias("p"), F.round(worse, 6).alias("p_worse"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("collection", F.round("u", 9).alias("u"), "s", (F.col("frequency") >= 2).alias("y"))


@add("boot_auroc")
def boot_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of utility with a 95 % percentile interval; replicates of one class are left out and counted."""
    b = resample.auroc_replicates(_labelled(spark, sf_dir), "collection", ["u"], "y", AUROC_REPLICATES, SEED)
    return b.agg(F.round(F.avg("u"), 6).alias("auc"), *resample.interval(b, "u"), (F.lit(AUROC_REPLICATES) - F.count("*")).alias("skipped"))


@add("boot_auroc_paired")
def boot_auroc_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the AUROC of score and of utility under the same draws: interval and two-sided p."""
    b = resample.auroc_replicates(_labelled(spark, sf_dir), "collection", ["s", "u"], "y", AUROC_REPLICATES, SEED)
    b = b.withColumn("d", F.col("s") - F.col("u"))
    return b.agg(F.round(F.avg("d"), 6).alias("diff"), *resample.interval(b, "d"), F.round(resample.two_sided("d"), 6).alias("p"), (F.lit(AUROC_REPLICATES) - F.count("*")).alias("skipped"))


@add("boot_kappa")
def boot_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of verdict and outcome without the neutral verdicts: interval, share of neutral ones, and whether it is 0.6 or more."""
    m = scored(spark, sf_dir).select("collection", "s", (F.col("u") > 0.5).alias("truth"))
    said = m.where("s > 0.55 OR s < 0.4").select("collection", (F.col("s") > 0.55).alias("said"), "truth")
    cells = resample.cell_replicates(said, "collection", ["said", "truth"], REPLICATES, SEED)
    n = lambda a, b: F.sum(F.when((F.col("said") == a) & (F.col("truth") == b), F.col("n")).otherwise(0))
    t = cells.groupBy("replicate").agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = (F.col("tp") + F.col("tn")) / total
    pe = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (total * total)
    k = t.where(total > 0).select(F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)).alias("k"))
    point = stats.kappa(said, "said", "truth").withColumnRenamed("n", "judged")
    neutral = m.agg(F.round(1 - F.avg(((F.col("s") > 0.55) | (F.col("s") < 0.4)).cast("int")), 6).alias("neutral"))
    passed = F.when(F.col("kappa") >= 0.6, "pass").otherwise("fail").alias("decision")
    return point.crossJoin(k.agg(*resample.interval(k, "k"))).crossJoin(neutral).select("kappa", "low", "high", "judged", "neutral", passed)


@add("dev_test_split", "SELECT context_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5('split:7:' || context_id)) <= round(0.3e0 * count(*) OVER (PARTITION BY source)) THEN 'dev' ELSE 'test' END AS split FROM contexts")
def dev_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three in ten contexts of each source as dev, by seeded hash order."""
    w = Window.partitionBy("source")
    nth = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("split:7:"), F.col("context_id").cast("string")))))
    return table(spark, sf_dir, "contexts").select("context_id", F.when(nth <= F.round(0.3 * F.count("*").over(w)), "dev").otherwise("test").alias("split"))


@add("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('sample:7:' || doc_id) LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by seeded hash order (the sampling operator itself)."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("sample:7:"), F.col("doc_id").cast("string")))).limit(50)
