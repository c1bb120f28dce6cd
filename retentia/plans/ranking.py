"""Search, rank fusion, budgets and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.functions import score as S
from retentia.operators import lexical, rank, vector
from retentia.plans.common import CAND, MEM, NOW, RRF, TOPIC_SQL, candidates, memories, query_vectors, sql_rerank, topic
from retentia.plans.registry import Registry
from retentia.sources.tables import table

registry = Registry()
add = registry.add


@add("knn_topk", f"WITH {CAND} SELECT memory_id, sim, sim_rank::int AS sim_rank FROM top WHERE qid = 0 AND sim_rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten memories nearest to one query."""
    one = query_vectors(spark, sf_dir).where("qid = 0")
    return vector.knn(one, "qid", "qv", memories(spark, sf_dir), "memory_id", "vector", 10).drop("qid")


@add("knn_batch", f"WITH {CAND} SELECT qid, memory_id, sim, sim_rank::int AS sim_rank FROM top")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(query_vectors(spark, sf_dir), "qid", "qv", memories(spark, sf_dir), "memory_id", "vector", 15)


def _metric(name: str, metric: str, sql: str) -> None:
    @add(
        name,
        f"""WITH {MEM}, q AS (SELECT vec_id AS qid, embedding::double[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
        s AS (SELECT qid, memory_id, round({sql}, 6) AS sim FROM q, mem WHERE len(vector) = 64)
        SELECT qid, memory_id, sim, rn::int AS sim_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, memory_id) AS rn FROM s) WHERE rn <= 5""",
    )
    def search(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vector.knn(query_vectors(spark, sf_dir), "qid", "qv", memories(spark, sf_dir), "memory_id", "vector", 5, metric)


_metric("knn_dot", "dot", "list_dot_product(qv, vector::double[])")
_metric("knn_euclid", "euclid", "-list_distance(qv, vector::double[])")


@add(
    "knn_filtered",
    f"""WITH {CAND}, g AS (SELECT s.qid, s.memory_id, s.sim, row_number() OVER (PARTITION BY s.qid ORDER BY s.sim DESC, s.memory_id) AS rn
      FROM sims s JOIN mem m USING (memory_id) WHERE m.utility >= 0.6e0) SELECT qid, memory_id, sim, rn::int AS sim_rank FROM g WHERE rn <= 10 AND sim >= 0.25e0""",
)
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among memories of enough stored utility, hits of enough similarity; the first filter goes below the search."""
    useful = memories(spark, sf_dir).where("utility >= 0.6")
    return vector.knn(query_vectors(spark, sf_dir), "qid", "qv", useful, "memory_id", "vector", 10).where("sim >= 0.25")


@add(
    "cosine_pairs",
    f"""WITH {MEM}, g AS (SELECT embedding::double[] AS g FROM embeddings WHERE vec_id = 0) SELECT memory_id, round(CASE WHEN list_dot_product(vector::double[], vector::double[]) > 0
      THEN list_dot_product(g, vector::double[]) / (sqrt(list_dot_product(g, g)) * sqrt(list_dot_product(vector::double[], vector::double[]))) ELSE 0e0 END, 6) AS cos FROM mem, g WHERE len(vector) = 64""",
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"]
    literal = F.array(*(F.lit(float(x)) for x in goal))
    return memories(spark, sf_dir).where(F.size("vector") == 64).select("memory_id", F.round(vector.cosine(literal, F.col("vector")), 6).alias("cos"))


_MODES = {
    "similarity": ("-sim_rank::double", {}),
    "rrf": (RRF, {}),
    "wrrf": ("0.7e0 / (60 + sim_rank) + 0.3e0 / (60 + s_rank)", {"beta_sim": 0.7, "beta_score": 0.3}),
    "blend": (
        "0.5e0 * (CASE WHEN max(sim) OVER (PARTITION BY qid) - min(sim) OVER (PARTITION BY qid) < 0.05e0 THEN 1e0 ELSE "
        "(sim - min(sim) OVER (PARTITION BY qid)) / (max(sim) OVER (PARTITION BY qid) - min(sim) OVER (PARTITION BY qid)) END) + 0.5e0 * s",
        {},
    ),
}


def _mode(mode: str) -> None:
    sql, options = _MODES[mode]

    @add(f"rerank_{mode}", f"WITH {sql_rerank(sql)} SELECT qid, memory_id, sim, s, fused, pos::int AS pos FROM final WHERE pos <= 3")
    def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rank.rerank(candidates(spark, sf_dir), mode, 3, **options).select("qid", "memory_id", "sim", "s", "fused", "pos")


for _m in _MODES:
    _mode(_m)


@add(
    "rerank_offline",
    f"""WITH {CAND}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, sim_rank) AS pos FROM cand) SELECT qid, memory_id, r, f, u, p, pos::int AS pos
    FROM (SELECT qid, memory_id, round(r, 6) AS r, round(f, 6) AS f, round(u, 6) AS u, round(p, 6) AS p, pos FROM o)""",
)
def rerank_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored candidates ordered by score alone."""
    c = candidates(spark, sf_dir).withColumn("pos", rank.score_rank())
    return c.select("qid", "memory_id", *(F.round(x, 6).alias(x) for x in "rfup"), "pos")


@add(
    "rank_extend",
    f"""WITH {CAND}, e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, sim_rank) AS sr FROM cand WHERE sim_rank <= 8),
    h AS (SELECT qid, memory_id, row_number() OVER (PARTITION BY qid ORDER BY round(1e0 / (60 + sim_rank) + 1e0 / (60 + sr), 9) DESC, sim_rank) AS hp FROM e)
    SELECT qid, memory_id, (CASE WHEN t.sim_rank <= 8 THEN h.hp ELSE t.sim_rank END)::int AS pos FROM top t LEFT JOIN h USING (qid, memory_id)""",
)
def rank_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight reranked, the rest in the order of similarity."""
    c = candidates(spark, sf_dir)
    head = rank.rerank(c.where("sim_rank <= 8"), "rrf").select("qid", "memory_id", "pos")
    tail = c.where("sim_rank > 8").select("qid", "memory_id", F.col("sim_rank").alias("pos"))
    return head.unionByName(tail)


_BM = """tok AS (SELECT doc_id AS d, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
  stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM tok),
  post AS (SELECT word, d, n, count(*) AS tf FROM (SELECT d, len(w) AS n, unnest(w) AS word FROM tok) GROUP BY ALL),
  idf0 AS (SELECT word, count(*) AS df, ln((n_docs - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf, avgdl FROM post, stats GROUP BY word, n_docs, avgdl),
  low AS (SELECT 0.25e0 * avg(idf) AS low FROM idf0),
  qw AS (SELECT q, word, count(*) AS times FROM (SELECT item_id AS q, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS word FROM eval_items WHERE item_id % 20 = 0) GROUP BY ALL),
  term AS (SELECT q, word, times, CASE WHEN idf < 0 THEN low ELSE idf END AS idf, avgdl FROM qw JOIN idf0 USING (word), low),
  bm AS (SELECT q, d, round(sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * n / avgdl))), 6) AS score FROM post JOIN term USING (word) GROUP BY q, d),
  bmr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rk FROM bm)"""


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    items = table(spark, sf_dir, "eval_items").where("item_id % 20 = 0")
    return lexical.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "question", k)


@add("bm25_rank", f"WITH {_BM} SELECT q AS item_id, d AS doc_id, score, rk::int AS rank FROM bmr WHERE rk <= 10")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10)


@add(
    "bm25_length_rrf",
    f"""WITH {_BM}, c AS (SELECT q, d, rk, row_number() OVER (PARTITION BY q ORDER BY n_tokens DESC NULLS LAST, rk) AS s_rank FROM bmr JOIN documents ON d = doc_id WHERE rk <= 15),
    z AS (SELECT *, round(1e0 / (60 + rk) + 1e0 / (60 + s_rank), 9) AS fused FROM c)
    SELECT q AS item_id, d AS doc_id, fused, pos::int AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, rk) AS pos FROM z) WHERE pos <= 5""",
)
def bm25_length_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexical first stage fused with a second signal, here the document's size."""
    first = _bm25(spark, sf_dir, 15).withColumnsRenamed({"rank": "sim_rank"})
    both = first.join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_tokens", F.lit(-1)).alias("s")), "doc_id")
    return rank.rerank(both, "rrf", 5, query="item_id").select("item_id", "doc_id", "fused", "pos")


@add(
    "rank_recency",
    f"WITH {MEM} SELECT collection, memory_id, row_number() OVER (PARTITION BY collection ORDER BY coalesce(recency_ts, created_ts) DESC, memory_id)::int AS pos FROM mem QUALIFY pos <= 20",
)
def rank_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most recently used memories of each collection."""
    w = Window.partitionBy("collection").orderBy(F.coalesce("recency_ts", "created_ts").desc(), "memory_id")
    return memories(spark, sf_dir).select("collection", "memory_id", F.row_number().over(w).alias("pos")).where("pos <= 20")


@add(
    "rank_random",
    f"WITH {CAND} SELECT qid, memory_id, row_number() OVER (PARTITION BY qid ORDER BY md5(concat('7:', qid, ':', memory_id)))::int AS pos FROM cand",
)
def rank_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded shuffle of each query's candidates that no storage order can sway."""
    w = Window.partitionBy("qid").orderBy(F.md5(F.concat(F.lit("7:"), F.col("qid").cast("string"), F.lit(":"), F.col("memory_id"))))
    return candidates(spark, sf_dir).select("qid", "memory_id", F.row_number().over(w).alias("pos"))


#: Candidates that recency is fused with (fixed value).
RECENCY_K = 50


@add(
    "fuse_recency",
    f"""WITH {CAND}, top50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, memory_id) AS sim_rank FROM sims) WHERE sim_rank <= {RECENCY_K}),
    a AS (SELECT qid, memory_id, sim_rank, row_number() OVER (PARTITION BY qid ORDER BY r DESC, sim_rank) AS rr FROM top50 JOIN comp USING (memory_id)), b AS (SELECT *, round(1e0 / (60 + sim_rank) + 1e0 / (60 + rr), 9) AS fused FROM a)
    SELECT qid, memory_id, fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, sim_rank)::int AS pos FROM b""",
)
def fuse_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most similar memories of a query, similarity fused with recency alone."""
    c = candidates(spark, sf_dir, RECENCY_K)
    return rank.rerank(c.withColumn("s", F.col("r")), "rrf").select("qid", "memory_id", "fused", "pos")


@add(
    "query_tail",
    """WITH w AS (SELECT item_id, string_split(trim(regexp_replace(question || ' ' || item_text, '\\s+', ' ', 'g')), ' ') AS w FROM eval_items)
    SELECT item_id, array_to_string(list_slice(w, greatest(1, len(w) - 31), len(w)), ' ') AS tail FROM w""",
)
def query_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 32 words of a query that is longer than the encoder's window."""
    w = F.split(F.trim(F.regexp_replace(F.concat_ws(" ", "question", "item_text"), r"\s+", " ")), " ")
    start = F.greatest(F.lit(1), F.size(w) - 31)
    return table(spark, sf_dir, "eval_items").select("item_id", F.array_join(F.slice(w, start, F.lit(32)), " ").alias("tail"))


@add(
    "rank_overlap",
    f"""WITH {sql_rerank(RRF)} SELECT qid, (count(*) FILTER (WHERE sim_rank <= 5 AND pos <= 5))::int AS shared, round(1 - (count(*) FILTER (WHERE sim_rank <= 5 AND pos <= 5)) / 5e0, 6) AS changed FROM final GROUP BY qid""",
)
def rank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first five stay among them after reranking."""
    both = F.sum(F.when((F.col("sim_rank") <= 5) & (F.col("pos") <= 5), 1).otherwise(0)).cast("int")
    return rank.rerank(candidates(spark, sf_dir), "rrf").groupBy("qid").agg(both.alias("shared")).withColumn("changed", F.round(1 - F.col("shared") / 5.0, 6))


@add(
    "rank_dynamics",
    f"""WITH {CAND}, n AS (SELECT qid, memory_id, sim_rank, s_rank, r, f, u, p, round(greatest(0e0, least(1e0, 0.3e0 * avg(r) OVER (PARTITION BY qid) + 0.2e0 * f + 0.3e0 * u + 0.2e0 * p)), 6) AS s2 FROM ranked),
    z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, sim_rank) AS r2 FROM n)
    SELECT qid, round(stddev_pop(r), 6) AS std_r, round(stddev_pop(f), 6) AS std_f, round(stddev_pop(u), 6) AS std_u, round(stddev_pop(p), 6) AS std_p, (count(*) FILTER (WHERE s_rank <= 5 AND r2 > 5))::int AS moved FROM z GROUP BY qid""",
)
def rank_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each component among a query's candidates, and how many leave the top five without recency's differences."""
    w = Window.partitionBy("qid")
    c = candidates(spark, sf_dir).withColumn("s_rank", rank.score_rank())
    c = c.withColumn("s2", S.composite(F.avg("r").over(w), F.col("f"), F.col("u"), F.col("p"))).withColumn("r2", rank.score_rank(score="s2"))
    moved = F.sum(F.when((F.col("s_rank") <= 5) & (F.col("r2") > 5), 1).otherwise(0)).cast("int").alias("moved")
    return c.groupBy("qid").agg(*(F.round(F.stddev_pop(x), 6).alias(f"std_{x}") for x in "rfup"), moved)


@add(
    "goal_window",
    """WITH e AS (SELECT vec_id, label, unnest(embedding::double[]) AS x, unnest(range(1, 65)) AS dim FROM embeddings),
    a AS (SELECT vec_id, dim, avg(x) OVER (PARTITION BY label, dim ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS x FROM e)
    SELECT vec_id, dim::int AS dim, round(x, 6) AS x FROM a WHERE x IS NOT NULL""",
)
def goal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of the three earlier queries of the same label, one row a dimension."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    w = Window.partitionBy("label", "dim").orderBy("vec_id").rowsBetween(-3, -1)
    return e.select("vec_id", (F.col("dim") + 1).alias("dim"), F.round(F.avg(F.col("x").cast("double")).over(w), 6).alias("x")).where("x IS NOT NULL")


@add(
    "goal_window_next",
    """WITH e AS (SELECT vec_id, label, unnest(embedding::double[]) AS x, unnest(range(1, 65)) AS dim FROM embeddings),
    a AS (SELECT vec_id, dim, avg(x) OVER (PARTITION BY label, dim ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS x FROM e)
    SELECT vec_id, dim::int AS dim, round(x, 6) AS x FROM a WHERE x IS NOT NULL""",
)
def goal_window_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of the three following queries of the same label (the oracle's goal), one row a dimension."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    w = Window.partitionBy("label", "dim").orderBy("vec_id").rowsBetween(1, 3)
    return e.select("vec_id", (F.col("dim") + 1).alias("dim"), F.round(F.avg(F.col("x").cast("double")).over(w), 6).alias("x")).where("x IS NOT NULL")


_TIE = {"stored": "memory_id", "reversed": "memory_id DESC", "similarity": "sim_rank", "seeded": "md5('7:' || memory_id)"}
_POLICY_RANKS = ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY round(u, 2) DESC, {t}) AS {n}" for n, t in _TIE.items())


@add(
    "replay_ties",
    f"""WITH {CAND}, k AS (SELECT qid, {_POLICY_RANKS} FROM cand) SELECT policy, count(*)::bigint AS queries, round(avg(same::int), 6) AS same_set FROM (SELECT qid, unnest(['stored', 'reversed', 'similarity']) AS policy,
      unnest([bool_and((stored <= 5) = (seeded <= 5)), bool_and((reversed <= 5) = (seeded <= 5)), bool_and((similarity <= 5) = (seeded <= 5))]) AS same FROM k GROUP BY qid) GROUP BY policy""",
)
def replay_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each way to break ties of utility shows the same five memories as the seeded one."""
    orders = {"stored": F.col("memory_id"), "reversed": F.desc("memory_id"), "similarity": F.col("sim_rank"), "seeded": F.md5(F.concat(F.lit("7:"), F.col("memory_id")))}
    rank_by = lambda o: F.row_number().over(Window.partitionBy("qid").orderBy(F.round("u", 2).desc(), o)) <= 5
    k = candidates(spark, sf_dir).select("qid", *(rank_by(o).alias(n) for n, o in orders.items()))
    each = F.array(*(F.struct(F.lit(n).alias("policy"), F.bool_and(F.col(n) == F.col("seeded")).alias("same")) for n in ("stored", "reversed", "similarity")))
    per = k.groupBy("qid").agg(each.alias("e")).select(F.explode("e").alias("e")).select("e.*")
    return per.groupBy("policy").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("same").cast("int")), 6).alias("same_set"))


_AGE = "0.005e0 * greatest({now}e0 - ({t}), 0e0) / 3600e0"


@add(
    "replay_times",
    f"""WITH {CAND}, v AS (SELECT qid, sim_rank, s_rank, f, u, p, coalesce(recency_ts, created_ts, 0e0) AS t, max(coalesce(recency_ts, created_ts, 0e0)) OVER (PARTITION BY qid) AS last FROM ranked),
    w AS (SELECT qid, s_rank, round(0.3e0 * exp(-{_AGE.format(now=NOW, t='last')}) + 0.2e0 * f + 0.3e0 * u + 0.2e0 * p, 6) AS equal, round(0.3e0 * exp(-{_AGE.format(now=NOW, t='last - 10e0 * sim_rank')}) + 0.2e0 * f + 0.3e0 * u + 0.2e0 * p, 6) AS steps, sim_rank FROM v),
    k AS (SELECT qid, s_rank, row_number() OVER (PARTITION BY qid ORDER BY equal DESC, sim_rank) AS equal, row_number() OVER (PARTITION BY qid ORDER BY steps DESC, sim_rank) AS steps FROM w)
    SELECT store, count(*)::bigint AS queries, round(avg(same::int), 6) AS same_set FROM (SELECT qid, unnest(['equal', 'steps']) AS store, unnest([bool_and((s_rank <= 5) = (equal <= 5)), bool_and((s_rank <= 5) = (steps <= 5))]) AS same FROM k GROUP BY qid) GROUP BY store""",
)
def replay_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the five best by score stay the same if all candidates were used at one time, or ten seconds apart."""
    w = Window.partitionBy("qid")
    c = candidates(spark, sf_dir).withColumn("s_rank", rank.score_rank()).withColumn("last", F.max(F.coalesce("recency_ts", "created_ts", F.lit(0.0))).over(w))
    times = {"equal": F.col("last"), "steps": F.col("last") - 10.0 * F.col("sim_rank")}
    for name, t in times.items():
        total = F.lit(0.3) * S.recency(t, NOW) + F.lit(0.2) * F.col("f") + F.lit(0.3) * F.col("u") + F.lit(0.2) * F.col("p")
        c = c.withColumn(f"s_{name}", F.round(total, 6)).withColumn(name, rank.score_rank(score=f"s_{name}"))
    each = F.array(*(F.struct(F.lit(n).alias("store"), F.bool_and((F.col("s_rank") <= 5) == (F.col(n) <= 5)).alias("same")) for n in times))
    per = c.groupBy("qid").agg(each.alias("e")).select(F.explode("e").alias("e")).select("e.*")
    return per.groupBy("store").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("same").cast("int")), 6).alias("same_set"))


@add(
    "evidence_rank",
    f"""WITH {CAND}, a AS (SELECT qid, memory_id, source, rank() OVER (PARTITION BY qid ORDER BY sim DESC) AS rk FROM sims JOIN mem USING (memory_id))
    SELECT qid, min(rk)::bigint AS best FROM a WHERE lower(trim(source)) = 'agent' GROUP BY qid""",
)
def evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition rank, among all memories, of the best evidence, here memories an agent wrote.

    The best evidence of each query is found first; then a second pass counts the memories nearer than it, so nothing is
    sorted and a task gives one number a query.
    """
    all_, q = memories(spark, sf_dir), query_vectors(spark, sf_dir)
    agent = all_.where(F.lower(F.trim("source")) == "agent")
    best = vector.knn(q, "qid", "qv", agent, "memory_id", "vector", 1).select("qid", F.col("sim").alias("bar"))
    return vector.nearer(q.join(best, "qid"), "qid", "qv", "bar", all_, "vector").select("qid", (F.col("n") + 1).alias("best"))


_COST = "(length(coalesce(text_content, '')) // 4 + 5)"


@add(
    "budget_cut",
    f"""WITH {sql_rerank(RRF)}, b AS (SELECT qid, memory_id, pos, sum({_COST}) OVER (PARTITION BY qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS spent FROM final)
    SELECT qid, memory_id, pos::int AS pos, spent::bigint AS spent FROM b WHERE spent <= 512""",
)
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest ranked prefix within 512 tokens, a quarter of the characters and five a memory."""
    ranked = rank.rerank(candidates(spark, sf_dir), "rrf")
    return rank.within_budget(ranked, _cost(), 512).select("qid", "memory_id", "pos", "spent")


def _cost():
    return F.floor(F.length(F.coalesce("text_content", F.lit(""))) / 4) + 5


@add(
    "prompt_units",
    f"""WITH {sql_rerank(RRF)}, b AS (SELECT qid, memory_id, pos, sum({_COST}) OVER (PARTITION BY qid ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS spent FROM final)
    SELECT qid, list_sort(list(memory_id)) AS shown FROM b WHERE spent <= 512 GROUP BY qid""",
)
def prompt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which memories fit when the best are displayed last."""
    ranked = rank.rerank(candidates(spark, sf_dir), "rrf").withColumn("back", -F.col("pos"))
    shown = rank.within_budget(ranked, _cost(), 512, pos="back")
    return shown.groupBy("qid").agg(F.array_sort(F.collect_list("memory_id")).alias("shown"))


@add(
    "evidence_metrics",
    f"""WITH {sql_rerank(RRF)}, h AS (SELECT qid, lower(trim(source)) AS g, min(pos) AS hit FROM final WHERE source IS NOT NULL AND trim(source) <> '' GROUP BY ALL),
    n AS (SELECT count(DISTINCT lower(trim(source))) AS n FROM mem WHERE trim(source) <> '')
    SELECT qid, round(count(*) FILTER (WHERE hit <= 5) / any_value(n)::double, 6) AS group_recall, (count(*) FILTER (WHERE hit <= 5) = any_value(n))::int AS all_covered, round(1e0 / min(hit), 6) AS mrr,
      round(coalesce(sum(1e0 / log2(hit + 1)) FILTER (WHERE hit <= 5), 0e0) / (SELECT sum(1e0 / log2(i + 1)) FROM range(1, 1 + least(5, (SELECT n FROM n))) t(i)), 6) AS ndcg FROM h, n GROUP BY qid""",
)
def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of evidence groups (writers), full coverage, MRR and nDCG of the first five."""
    ranked = rank.rerank(candidates(spark, sf_dir), "rrf")
    group = F.lower(F.trim("source"))
    n = memories(spark, sf_dir).where(group != "").agg(F.countDistinct(group).alias("n"))
    hits = ranked.where(group != "").groupBy("qid", group.alias("g")).agg(F.min("pos").alias("hit"))
    five = F.col("hit") <= 5
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    got = F.sum(F.when(five, 1).otherwise(0))
    m = hits.groupBy("qid").agg(got.alias("got"), F.min("hit").alias("first"), F.sum(F.when(five, F.lit(1.0) / F.log2(F.col("hit") + 1.0)).otherwise(0.0)).alias("dcg"))
    m = m.crossJoin(F.broadcast(n))
    return m.select(
        "qid", F.round(F.col("got") / F.col("n"), 6).alias("group_recall"), (F.col("got") == F.col("n")).cast("int").alias("all_covered"),
        F.round(F.lit(1.0) / F.col("first"), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


@add(
    "precedence",
    f"""WITH {sql_rerank(RRF)}, fam AS (SELECT memory_id, created_ts, {TOPIC_SQL} AS family FROM mem),
    gold AS (SELECT family, arg_max(memory_id, (created_ts, memory_id)) AS gold, count(*) AS versions FROM fam WHERE created_ts IS NOT NULL GROUP BY family),
    r AS (SELECT qid, memory_id, pos, sim_rank, family FROM final JOIN fam USING (memory_id)), asked AS (SELECT qid, family FROM r WHERE sim_rank = 1),
    x AS (SELECT a.qid, g.versions, g.gold, r.memory_id, r.pos FROM asked a JOIN gold g USING (family) LEFT JOIN r ON r.qid = a.qid AND r.family = a.family)
    SELECT qid, CASE WHEN versions < 2 THEN NULL WHEN min(pos) FILTER (WHERE memory_id = gold) IS NULL THEN 0 WHEN min(pos) FILTER (WHERE memory_id = gold) = min(pos) THEN 1 ELSE 0 END::int AS precedence FROM x GROUP BY qid, versions, gold""",
)
def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the newest version of a query's fact ranks above every other version that was retrieved.

    The label comes from the whole store: a query asks about the topic of its nearest memory, the newest memory of that
    topic is gold and the others are its older versions. 0 if gold isn't retrieved, null if there is no other version.
    """
    family = memories(spark, sf_dir).select("memory_id", "created_ts", topic().alias("family"))
    gold = family.where("created_ts IS NOT NULL").groupBy("family").agg(F.max_by("memory_id", F.struct("created_ts", "memory_id")).alias("gold"), F.count("*").alias("versions"))
    r = rank.rerank(candidates(spark, sf_dir), "rrf").select("qid", "memory_id", "pos", "sim_rank").join(family.select("memory_id", "family"), "memory_id")
    asked = F.max(F.when(F.col("sim_rank") == 1, F.col("family"))).over(Window.partitionBy("qid"))
    r = r.withColumn("asked", asked).where(F.col("asked") == F.col("family")).join(gold, "family")
    n = r.groupBy("qid", "versions").agg(F.min(F.when(F.col("memory_id") == F.col("gold"), F.col("pos"))).alias("at"), F.min("pos").alias("best"))
    held = F.when(F.col("at").isNull(), 0).otherwise((F.col("at") == F.col("best")).cast("int"))
    return n.select("qid", F.when(F.col("versions") >= 2, held).alias("precedence"))


@add(
    "mrr_hit1",
    f"""WITH {sql_rerank(RRF)} SELECT qid, round(coalesce(1e0 / min(pos) FILTER (WHERE frequency >= 5), 0e0), 6) AS mrr, coalesce(min(pos) FILTER (WHERE frequency >= 5) = 1, false)::int AS hit1 FROM final GROUP BY qid""",
)
def mrr_hit1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank and hit at 1 of the first true candidate, here one used five times or more."""
    first = F.min(F.when(F.col("frequency") >= 5, F.col("pos")))
    m = rank.rerank(candidates(spark, sf_dir), "rrf").groupBy("qid").agg(first.alias("x"))
    return m.select("qid", F.round(F.coalesce(F.lit(1.0) / F.col("x"), F.lit(0.0)), 6).alias("mrr"), F.coalesce((F.col("x") == 1).cast("int"), F.lit(0)).alias("hit1"))


_ESC = "replace(replace(replace(replace(replace(replace(coalesce(text_content, ''), chr(0), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def xml_escaped(text):
    for bad, good in (("\0", ""), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


@add("xml_escape", f"WITH {MEM} SELECT memory_id, {_ESC} AS escaped FROM mem")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("memory_id", xml_escaped(F.coalesce("text_content", F.lit(""))).alias("escaped"))


#: Characters of a memory's text and of a prompt (fixed values).
TEXT_CHARS, PROMPT_CHARS = 10_000, 20_000
_CUT = _ESC.replace("coalesce(text_content, '')", f"left(coalesce(text_content, ''), {TEXT_CHARS})")
_LINES = f"""{sql_rerank(RRF)}, l AS (SELECT qid, memory_id, pos, length(coalesce(text_content, '')) > {TEXT_CHARS} AS long, '  <memory id="' || pos || '" weight="' || printf('%.2f', s) || '">' || {_CUT} || '</memory>' AS line FROM final),
    b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM l)"""


def _prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, memory_id, pos, long, line, used): ranked memories as escaped lines with their score; long ones cut."""
    ranked = rank.rerank(candidates(spark, sf_dir), "rrf").withColumn("text", F.coalesce("text_content", F.lit("")))
    head = F.concat(F.lit('  <memory id="'), F.col("pos").cast("string"), F.lit('" weight="'), F.format_string("%.2f", "s"), F.lit('">'))
    line = F.concat(head, xml_escaped(F.substring("text", 1, TEXT_CHARS)), F.lit("</memory>"))
    w = Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = ranked.select("qid", "memory_id", "pos", (F.length("text") > TEXT_CHARS).alias("long"), line.alias("line"))
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(w))


@add(
    "xml_prompt",
    f"""WITH {_LINES} SELECT qid, '<memories>' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) || '</memories>' AS prompt FROM b WHERE used <= {PROMPT_CHARS} GROUP BY qid""",
)
def xml_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each query: ranked memories, escaped, until the first that doesn't fit in 20,000 characters."""
    shown = _prompt_lines(spark, sf_dir).where(F.col("used") <= PROMPT_CHARS)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return shown.groupBy("qid").agg(F.concat(F.lit("<memories>\n"), F.array_join(lines, "\n"), F.lit("\n</memories>")).alias("prompt"))


@add("prompt_overflow", f"WITH {_LINES} SELECT DISTINCT memory_id FROM b WHERE long OR used > {PROMPT_CHARS}")
def prompt_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that go to the distillation queue: cut in a prompt, or left out of one for want of room."""
    return _prompt_lines(spark, sf_dir).where(F.col("long") | (F.col("used") > PROMPT_CHARS)).select("memory_id").distinct()


@add(
    "format_memories",
    f"""WITH {sql_rerank(RRF)} SELECT qid, string_agg('Memory ' || pos || ':' || chr(10) || coalesce(text_content, ''), chr(10) ORDER BY pos) AS prompt FROM final WHERE pos <= 3 GROUP BY qid""",
)
def format_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three memories as numbered blocks."""
    block = F.concat(F.lit("Memory "), F.col("pos").cast("string"), F.lit(":\n"), F.coalesce("text_content", F.lit("")))
    top = rank.rerank(candidates(spark, sf_dir), "rrf", 3).select("qid", "pos", block.alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"])
    return top.groupBy("qid").agg(F.array_join(blocks, "\n").alias("prompt"))


@add(
    "identical_sets",
    f"""WITH {sql_rerank(RRF)}, a AS (SELECT qid, list_sort(list(memory_id) FILTER (WHERE sim_rank <= 5)) = list_sort(list(memory_id) FILTER (WHERE pos <= 5)) AS same FROM final GROUP BY qid)
    SELECT count(*)::bigint AS n, round(avg(same::int), 6) AS share FROM a""",
)
def identical_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries whose first five hold the same memories before and after reranking."""
    r = rank.rerank(candidates(spark, sf_dir), "rrf")
    top = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) <= 5, F.col("memory_id"))))
    same = r.groupBy("qid").agg((top("sim_rank") == top("pos")).cast("int").alias("same"))
    return same.agg(F.count("*").alias("n"), F.round(F.avg("same"), 6).alias("share"))


@add(
    "set_overlap",
    f"""WITH {sql_rerank(RRF)}, a AS (SELECT qid, list(memory_id) FILTER (WHERE sim_rank <= 5) AS x, list(memory_id) FILTER (WHERE pos <= 5) AS y FROM final GROUP BY qid)
    SELECT qid, len(list_intersect(x, y))::int AS both, len(list_filter(y, lambda m: NOT list_contains(x, m)))::int AS entered FROM a""",
)
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rank.rerank(candidates(spark, sf_dir), "rrf").groupBy("qid").agg(
        F.collect_list(F.when(F.col("sim_rank") <= 5, F.col("memory_id"))).alias("x"), F.collect_list(F.when(F.col("pos") <= 5, F.col("memory_id"))).alias("y")
    )
    return r.select("qid", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_except("y", "x")).alias("entered"))


@add(
    "kendall_tau",
    f"""WITH {CAND} SELECT a.qid, round(sum(sign(a.sim_rank - b.sim_rank) * sign(a.s_rank - b.s_rank)) / count(*)::double, 6) AS tau
    FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.sim_rank < b.sim_rank GROUP BY a.qid""",
)
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the orders by similarity and by score over a query's fifteen candidates."""
    r = candidates(spark, sf_dir).withColumn("s_rank", rank.score_rank()).groupBy("qid").agg(F.collect_list(F.struct("sim_rank", "s_rank")).alias("c"))
    r = r.select("qid", F.explode("c").alias("a"), "c").select("qid", "a", F.explode("c").alias("b")).where("a.sim_rank < b.sim_rank")
    return r.groupBy("qid").agg(F.round(F.avg(F.sign(F.col("a.sim_rank") - F.col("b.sim_rank")) * F.sign(F.col("a.s_rank") - F.col("b.s_rank"))), 6).alias("tau"))


@add(
    "tie_boundary",
    f"""WITH {CAND}, a AS (SELECT qid, max(s) FILTER (WHERE s_rank = 5) AS inside, max(s) FILTER (WHERE s_rank = 6) AS outside FROM ranked GROUP BY qid)
    SELECT qid, (inside = outside)::int AS tie FROM a WHERE outside IS NOT NULL""",
)
def tie_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether equal scores stand on both sides of the fifth place."""
    r = candidates(spark, sf_dir).withColumn("s_rank", rank.score_rank()).groupBy("qid")
    at = lambda n: F.max(F.when(F.col("s_rank") == n, F.col("s")))
    return r.agg(at(5).alias("a"), at(6).alias("b")).where("b IS NOT NULL").select("qid", (F.col("a") == F.col("b")).cast("int").alias("tie"))
