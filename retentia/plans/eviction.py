"""Eviction policies, joins over facts and their evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.functions import providers
from retentia.operators import rank, vector
from retentia.operators.lexical import contains_any, nearest_bag, words
from retentia.plans.common import COMP, MEM, NOW, memories, scored
from retentia.plans.registry import Registry
from retentia.plans.scoring import _FACT, facts
from retentia.sources.tables import table

registry = Registry()
add = registry.add

#: Key by which each policy evicts first (ascending), as Spark and as DuckDB expressions over scored memories.
POLICIES = {
    "retention": ("s", "s"),
    "lru": ("coalesce(recency_ts, created_ts)", "coalesce(recency_ts, created_ts)"),
    "lfu": ("cast(frequency as double)", "frequency::double"),
    "fifo": ("created_ts", "created_ts"),
    "random": ("0D", "0e0"),
    "forgetting": (f"round(exp(-(greatest({NOW}D - coalesce(recency_ts, created_ts), 0D) / 86400D) / (1D + frequency)), 9)", f"round(exp(-(greatest({NOW}e0 - coalesce(recency_ts, created_ts), 0e0) / 86400e0) / (1e0 + frequency)), 9)"),
    "utility": ("round(u, 9)", "round(u, 9)"),
    "predictive": ("round(p, 9)", "round(p, 9)"),
    "no_recency": ("round((0.2D * f + 0.3D * u + 0.2D * p) / 0.7D, 9)", "round((0.2e0 * f + 0.3e0 * u + 0.2e0 * p) / 0.7e0, 9)"),
}


def evicted(memories: DataFrame, key: str, keep: float, group: str = "collection") -> DataFrame:
    """Memories beyond a group's capacity ceil(keep x n): lowest key first, ties by a hash that no order of ids can sway."""
    m = memories.select(group, "memory_id", F.expr(key).alias("key"), F.md5(F.concat(F.lit("evict:"), F.col("memory_id"))).alias("tie"))
    m = rank.rank_within(m, [group], "key", "tie", "nth")
    return m.where(F.col("nth") <= F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * keep))).select(group, "memory_id", F.col("nth").alias("place"))


def _policy(name: str) -> None:
    spark_key, sql_key = POLICIES[name]

    @add(
        f"evict_{name}",
        f"""WITH {COMP}, e AS (SELECT collection, memory_id, row_number() OVER (PARTITION BY collection ORDER BY {sql_key}, md5('evict:' || memory_id), memory_id) AS nth, count(*) OVER (PARTITION BY collection) AS n FROM scored)
        SELECT collection, memory_id, nth::bigint AS place FROM e WHERE nth <= n - greatest(1, ceil(n * 0.5e0))""",
    )
    def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evicted(scored(spark, sf_dir), spark_key, 0.5)


for _p in POLICIES:
    _policy(_p)


_FRESH = f"pow(0.995e0, greatest({NOW}e0 - coalesce(recency_ts, created_ts, 0e0), 0e0) / 3600e0)"


@add(
    "evict_agents",
    f"""WITH {COMP}, a AS (SELECT collection, memory_id, {_FRESH} AS rec, coalesce(len(regexp_extract_all(lower(text_content), '[a-z0-9]+')), 0)::double AS imp FROM scored),
    b AS (SELECT *, min(rec) OVER w AS r0, max(rec) OVER w AS r1, min(imp) OVER w AS i0, max(imp) OVER w AS i1, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY collection)),
    k AS (SELECT *, round(CASE WHEN r1 > r0 THEN (rec - r0) / (r1 - r0) ELSE 0e0 END + CASE WHEN i1 > i0 THEN (imp - i0) / (i1 - i0) ELSE 0e0 END, 9) AS key FROM b),
    e AS (SELECT collection, memory_id, n, row_number() OVER (PARTITION BY collection ORDER BY key, md5('evict:' || memory_id), memory_id) AS nth FROM k)
    SELECT collection, memory_id, nth::bigint AS place FROM e WHERE nth <= n - greatest(1, ceil(n * 0.5e0))""",
)
def evict_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eviction by recency plus importance, each scaled to its spread in the collection; words stand for the importance."""
    rec = F.pow(F.lit(0.995), F.greatest(F.lit(NOW) - F.coalesce("recency_ts", "created_ts", F.lit(0.0)), F.lit(0.0)) / 3600.0)
    a = scored(spark, sf_dir).select("collection", "memory_id", rec.alias("rec"), F.size(words(F.col("text_content"))).cast("double").alias("imp"))
    span = a.groupBy("collection").agg(F.min("rec").alias("r0"), F.max("rec").alias("r1"), F.min("imp").alias("i0"), F.max("imp").alias("i1")).withColumnRenamed("collection", "c")
    scaled = lambda x, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.lit(0.0))
    k = a.join(span, F.col("collection").eqNullSafe(F.col("c"))).withColumn("key", F.round(scaled("rec", "r0", "r1") + scaled("imp", "i0", "i1"), 9))
    return evicted(k.select("collection", "memory_id", "key"), "key", 0.5)


@add(
    "policy_scores",
    f"""WITH {COMP} SELECT memory_id, policy, round(score, 6) AS score FROM (SELECT memory_id, unnest(['retention', 'lfu', 'fifo', 'utility', 'predictive']) AS policy, unnest([s, frequency::double, created_ts, u, p]) AS score FROM scored)""",
)
def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory's score under each policy, long form."""
    pairs = {"retention": "s", "lfu": "frequency", "fifo": "created_ts", "utility": "u", "predictive": "p"}
    each = F.array(*(F.struct(F.lit(k).alias("policy"), F.round(F.col(c).cast("double"), 6).alias("score")) for k, c in pairs.items()))
    return scored(spark, sf_dir).select("memory_id", F.explode(each).alias("x")).select("memory_id", "x.*")


@add(
    "harmful_deletion",
    f"""WITH {_FACT}, a AS (SELECT dialogue, cluster_id, len(list_filter(sessions, lambda x: x > created_session)) > 0 AS needed,
      row_number() OVER (PARTITION BY dialogue ORDER BY coalesce(mentions, 0) DESC, md5('evict:' || cluster_id)) AS rk, count(*) OVER (PARTITION BY dialogue) AS n FROM fact WHERE sessions IS NOT NULL)
    SELECT dialogue, round((count(*) FILTER (WHERE needed AND rk > greatest(1, ceil(0.5e0 * n)))) / (count(*) FILTER (WHERE needed))::double, 6) AS harm FROM a GROUP BY dialogue HAVING count(*) FILTER (WHERE needed) > 0""",
)
def harmful_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a dialogue's restated facts that keeping the half with most mentions loses."""
    f = facts(spark, sf_dir).where("sessions IS NOT NULL")
    needed = F.size(F.filter("sessions", lambda x: x > F.col("created_session"))) > 0
    f = f.select("dialogue", "cluster_id", needed.alias("needed"), (-F.coalesce("mentions", F.lit(0))).alias("m"), F.md5(F.concat(F.lit("evict:"), F.col("cluster_id"))).alias("tie"))
    f = rank.rank_within(f, ["dialogue"], "m", "tie", "rk").withColumn("lost", F.col("rk") > F.greatest(F.lit(1), F.ceil(F.col("n") * 0.5)))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = f.groupBy("dialogue").agg(one(F.col("needed") & F.col("lost")).alias("a"), one(F.col("needed")).alias("b")).where("b > 0")
    return g.select("dialogue", F.round(F.col("a") / F.col("b"), 6).alias("harm"))


@add(
    "keep_mask",
    f"""WITH {COMP}, n AS (SELECT ceil(count(*) * 0.25e0) AS k FROM mem), b AS (SELECT memory_id FROM scored ORDER BY s DESC, md5('evict:' || memory_id) LIMIT (SELECT k::int FROM n)) SELECT memory_id FROM b""",
)
def keep_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quarter of all memories, ranked without a window or a limit over all of them."""
    m = scored(spark, sf_dir).select("memory_id", (-F.col("s")).alias("key"), F.md5(F.concat(F.lit("evict:"), F.col("memory_id"))).alias("tie"), F.lit(1).alias("one"))
    return rank.rank_within(m, ["one"], "key", "tie").where(F.col("place") <= F.ceil(F.col("n") * 0.25)).select("memory_id")


@add("triage_scan", f"WITH {COMP} SELECT memory_id, s, left(coalesce(text_content, ''), 80) AS preview FROM scored")
def triage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memories with score and preview, lowest first."""
    return scored(spark, sf_dir).select("memory_id", "s", F.substring(F.coalesce("text_content", F.lit("")), 1, 80).alias("preview")).orderBy("s", "memory_id")


@add(
    "rank_tiebreak",
    f"""WITH {COMP} SELECT collection, memory_id, row_number() OVER (PARTITION BY collection ORDER BY round(u, 6) DESC, md5('tie:' || memory_id))::int AS pos FROM scored QUALIFY pos <= 25""",
)
def rank_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 of each collection by utility, ties in seeded random order."""
    w = Window.partitionBy("collection").orderBy(F.round("u", 6).desc(), F.md5(F.concat(F.lit("tie:"), F.col("memory_id"))))
    return scored(spark, sf_dir).select("collection", "memory_id", F.row_number().over(w).alias("pos")).where("pos <= 25")


@add(
    "eval_candidates",
    f"""WITH {MEM}, loc AS (SELECT memory_id, regexp_extract(text_content, 'was on ([a-z]+) [0-9]+', 1) AS place FROM mem), c AS (SELECT * FROM loc WHERE place <> '')
    SELECT a.place, count(*)::bigint AS candidates, count(DISTINCT a.memory_id)::bigint AS reachable FROM c a GROUP BY a.place""",
)
def eval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that could answer a question about each place."""
    place = F.regexp_extract("text_content", "was on ([a-z]+) [0-9]+", 1)
    c = memories(spark, sf_dir).select("memory_id", place.alias("place")).where("place <> ''")
    return c.groupBy("place").agg(F.count("*").alias("candidates"), F.countDistinct("memory_id").alias("reachable"))


# Joins


@add("paired_join", f"WITH {COMP} SELECT a.memory_id, round(a.s - b.score, 6) AS diff FROM scored a JOIN (SELECT memory_id, round(u, 6) AS score FROM comp) b USING (memory_id)")
def paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results of the same items joined on their key, with the difference."""
    m = scored(spark, sf_dir)
    other = m.select("memory_id", F.round("u", 6).alias("score"))
    return m.select("memory_id", "s").join(other, "memory_id").select("memory_id", F.round(F.col("s") - F.col("score"), 6).alias("diff"))


@add("left_default_join", f"WITH {MEM} SELECT m.memory_id, coalesce(e.v, 5)::int AS rating FROM mem m LEFT JOIN (SELECT memory_id, length(text_content) % 10 + 1 AS v FROM mem WHERE source = 'agent' AND text_content IS NOT NULL) e USING (memory_id)")
def left_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings looked up by key, 5 where there is none."""
    m = memories(spark, sf_dir)
    rated = m.where("source = 'agent' AND text_content IS NOT NULL").select("memory_id", (F.length("text_content") % 10 + 1).alias("v"))
    return m.select("memory_id").join(rated, "memory_id", "left").select("memory_id", F.coalesce("v", F.lit(5)).alias("rating"))


@add("needed_semi", "SELECT cluster_id, dialogue FROM fact_clusters f WHERE EXISTS (SELECT 1 FROM contexts c WHERE c.context_index = f.dialogue % 100)")
def needed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose dialogue a context asks about."""
    f = table(spark, sf_dir, "fact_clusters").select("cluster_id", "dialogue", (F.col("dialogue") % 100).alias("i"))
    asked = table(spark, sf_dir, "contexts").select(F.col("context_index").alias("i"))
    return f.join(asked, "i", "left_semi").select("cluster_id", "dialogue")


def fact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialogue, speaker, cluster_id, size, bag): canonical facts with each different word and how often it occurs."""
    f = facts(spark, sf_dir).select("dialogue", "speaker", "cluster_id", words(F.col("canonical")).alias("w")).where(F.size("w") > 0)
    bag = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("word"), F.size(F.filter("w", lambda y: y == x)).alias("n")))
    return f.select("dialogue", "speaker", "cluster_id", F.size("w").alias("size"), bag.alias("bag"))


_WORDS = f"""{_FACT}, fw AS (SELECT dialogue, speaker, cluster_id, size, word, count(*) AS n FROM (SELECT dialogue, speaker, cluster_id, len(w) AS size, unnest(w) AS word
    FROM (SELECT dialogue, speaker, cluster_id, regexp_extract_all(lower(canonical), '[a-z0-9]+') AS w FROM fact WHERE canonical IS NOT NULL)) GROUP BY ALL),
  f1 AS (SELECT a.dialogue, a.speaker, a.cluster_id AS x, b.cluster_id AS y, round(2e0 * sum(least(a.n, b.n)) / (a.size + b.size), 6) AS f1 FROM fw a JOIN fw b
    ON a.dialogue = b.dialogue AND a.speaker = b.speaker AND a.word = b.word AND a.cluster_id < b.cluster_id GROUP BY a.dialogue, a.speaker, a.cluster_id, b.cluster_id, a.size, b.size)"""


def word_f1(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    """Token F1 of the facts of one speaker of a dialogue: (dialogue, speaker, x, y, f1), x before y, f1 of `least` or more and not 0.

    Two facts at F1 t share t / (2 - t) of either one's words at least, so one of their first words, rarest first, is the
    same; only facts under such a word meet (a word that every fact of a speaker holds is seldom among them), and the
    bags are compared in full afterwards.
    """
    f = fact_words(spark, sf_dir)
    key = ["dialogue", "speaker"]
    each = f.select(*key, "cluster_id", "size", F.explode("bag").alias("b")).select(*key, "cluster_id", "size", "b.*")
    often = each.groupBy(*key, "word").agg(F.count("*").alias("df"))
    ranked = each.join(often, [*key, "word"]).groupBy(*key, "cluster_id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "word", "n"))).alias("b"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("size") * (least / (2.0 - least)) - 1e-9))
    # words whose first occurrence is among the first size - needed + 1
    at = F.transform("b", lambda x, i: F.struct(x["word"].alias("word"), F.aggregate(F.slice("b", 1, i), F.lit(0), lambda s, y: s + y["n"]).alias("before")))
    first = ranked.select(*key, "cluster_id", "size", F.explode(F.filter(at, lambda x: x["before"] <= F.col("size") - needed)).alias("p"))
    first = first.select(*key, F.col("p.word").alias("word"), "cluster_id", "size")
    a = first.select(*key, "word", F.col("cluster_id").alias("x"), F.col("size").alias("sx"))
    b = first.select(*key, "word", F.col("cluster_id").alias("y"), F.col("size").alias("sy"))
    near = F.least("sx", "sy") * 2 >= (F.col("sx") + F.col("sy")) * (least - 1e-9)
    met = a.join(b, [*key, "word"]).where(F.col("x") < F.col("y")).where(near).select(*key, "x", "y").distinct()
    bags = f.select("cluster_id", "size", F.map_from_entries("bag").alias("bag"))
    left = bags.select(F.col("cluster_id").alias("x"), F.col("size").alias("sx"), F.col("bag").alias("bx"))
    right = bags.select(F.col("cluster_id").alias("y"), F.col("size").alias("sy"), F.col("bag").alias("by"))
    both = met.join(left, "x").join(right, "y")
    shared = F.aggregate(F.map_entries("bx"), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at("by", e["key"]), F.lit(0))))
    scored_ = both.select(*key, "x", "y", F.round(F.lit(2.0) * shared / (F.col("sx") + F.col("sy")), 6).alias("f1"))
    return scored_.where((F.col("f1") >= least) & (F.col("f1") > 0))


@add("token_f1", f"WITH {_WORDS} SELECT dialogue, speaker, x, y, f1 FROM f1 WHERE f1 >= 0.3e0")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one speaker's facts with a token F1 of 0.3 or more."""
    return word_f1(spark, sf_dir, 0.3)


@add(
    "best_match",
    f"""WITH {_WORDS}, pairs AS (SELECT x, y, f1 FROM f1 UNION ALL SELECT y, x, f1 FROM f1),
    b AS (SELECT x, y, f1 FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY f1 DESC, y) AS rn FROM pairs WHERE f1 > 0) WHERE rn = 1)
    SELECT cluster_id, y AS best, coalesce(f1, 0e0) AS f1 FROM fact LEFT JOIN b ON x = cluster_id""",
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact's most similar other fact of the same speaker, the first of equals; null and 0 where no word is shared."""
    rows = table(spark, sf_dir, "fact_clusters").where("cluster_id IS NOT NULL")
    best = nearest_bag(facts(spark, sf_dir), ["dialogue", "speaker"], "cluster_id", "canonical", rows)
    all_ = rows.select("cluster_id").distinct().join(best, "cluster_id", "left")
    return all_.select("cluster_id", F.col("other").alias("best"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def ordered_facts(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """(dialogue, speaker, cluster_id, created_ts, near): facts with their edges to others, near array<struct<y, f1>>."""
    both = edges.select("x", "y", "f1").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"), "f1"))
    near = both.groupBy("x").agg(F.collect_list(F.struct("y", "f1")).alias("near")).withColumnRenamed("x", "cluster_id")
    return facts(spark, sf_dir).select("dialogue", "speaker", "cluster_id", "created_ts").join(near, "cluster_id", "left")


def fact_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, cluster_id, vector) of canonical facts by the offline encoder; a group is one speaker of a dialogue."""
    f = facts(spark, sf_dir).where("canonical IS NOT NULL AND dialogue IS NOT NULL AND speaker IS NOT NULL")
    group = F.concat_ws(":", F.col("dialogue").cast("string"), F.col("speaker").cast("string"))
    return f.select(group.alias("group"), "cluster_id", providers.hashing_vector(F.col("canonical")).alias("vector"))


def lead(pdf: pd.DataFrame) -> pd.DataFrame:
    """Leader clustering of one speaker's facts in order of creation: the first leader near enough takes a fact, else it leads."""
    pdf = pdf.sort_values(["created_ts", "cluster_id"], na_position="first")
    place: dict[str, int] = {}
    out = []
    for c, near in zip(pdf.cluster_id, pdf.near):
        mine = min((x["y"] for x in (near if near is not None else ()) if x["y"] in place), key=place.get, default=None)
        if mine is None:
            place[c] = len(place)
        out.append(c if mine is None else mine)
    return pdf.assign(leader=out)[["dialogue", "cluster_id", "leader"]]


# A fold over facts in order, as recursion over their number; {pick} chooses among the leaders near the next fact.
def _fold_sql(edges: str, pick: str) -> str:
    return f"""o AS (SELECT dialogue, speaker, cluster_id, row_number() OVER (PARTITION BY dialogue, speaker ORDER BY created_ts NULLS FIRST, cluster_id) AS nth FROM fact),
    ed AS (SELECT x, y, f1 FROM {edges} UNION ALL SELECT y, x, f1 FROM {edges}), near AS (SELECT x, list({{'y': y, 'f1': f1}}) AS near FROM ed GROUP BY x),
    k AS (SELECT o.*, coalesce(near, []) AS near FROM o LEFT JOIN near ON x = cluster_id),
    rec AS (SELECT dialogue, speaker, nth, cluster_id, cluster_id AS leader, [cluster_id] AS leaders FROM k WHERE nth = 1
      UNION ALL SELECT k.dialogue, k.speaker, k.nth, k.cluster_id, coalesce({pick}, k.cluster_id),
        CASE WHEN {pick} IS NULL THEN list_append(rec.leaders, k.cluster_id) ELSE rec.leaders END
      FROM rec JOIN k ON k.dialogue IS NOT DISTINCT FROM rec.dialogue AND k.speaker IS NOT DISTINCT FROM rec.speaker AND k.nth = rec.nth + 1)"""


_FIRST = "list_filter(rec.leaders, lambda l: list_contains(list_transform(k.near, lambda e: e.y), l))[1]"
_WORDS_OF = "regexp_extract_all(lower(canonical), '[a-z0-9]+')"
_NUMBER = "('0x' || substr(md5(w), 1, 8))::bigint"
_HASHED = f"""{_FACT}, hw AS (SELECT dialogue, speaker, cluster_id, h % 64 AS dim, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::double AS x FROM (SELECT dialogue, speaker, cluster_id, {_NUMBER} AS h
      FROM (SELECT dialogue, speaker, cluster_id, unnest({_WORDS_OF}) AS w FROM fact WHERE canonical IS NOT NULL AND dialogue IS NOT NULL AND speaker IS NOT NULL)) GROUP BY ALL),
    hn AS (SELECT cluster_id, sum(x * x) AS n FROM hw GROUP BY cluster_id HAVING sum(x * x) > 0),
    cs AS (SELECT a.dialogue, a.speaker, a.cluster_id AS x, b.cluster_id AS y, round(sum(a.x * b.x) / (sqrt(any_value(na.n)) * sqrt(any_value(nb.n))), 6) AS f1 FROM hw a JOIN hw b ON a.dialogue = b.dialogue AND a.speaker = b.speaker AND a.dim = b.dim
      AND a.cluster_id < b.cluster_id JOIN hn na ON na.cluster_id = a.cluster_id JOIN hn nb ON nb.cluster_id = b.cluster_id GROUP BY ALL),
    near_cs AS (SELECT * FROM cs WHERE f1 >= 0.75e0)"""


@add("fact_groups", f"WITH RECURSIVE {_HASHED}, {_fold_sql('near_cs', _FIRST)} SELECT dialogue, cluster_id, leader FROM rec")
def fact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy leader clustering of each speaker's facts in order of creation, near at a cosine of 0.75 or more.

    Order-dependent, so a fold per speaker and dialogue; it gets ids and edges, never texts or vectors.
    """
    edges = vector.pairs_within(fact_vectors(spark, sf_dir), "group", "cluster_id", "vector", 0.75).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("cos").alias("f1"))
    return ordered_facts(spark, sf_dir, edges).groupBy("dialogue", "speaker").applyInPandas(lead, "dialogue long, cluster_id string, leader string")


def _hour(column: str):
    return F.floor(F.col(column) / 3600)


def visible_at(contexts: DataFrame, m: DataFrame) -> DataFrame:
    """(context_id, visible, latest): memories that existed when each context was asked.

    Both sides become one stream ordered by time, in which the memories before a row are counted: within its hour, and
    over the hours before from one row an hour. No pair is ever built.
    """
    stored = m.where("created_ts IS NOT NULL").select(F.col("created_ts").alias("t"), F.lit(0).alias("kind"), "memory_id", F.lit(None).cast("long").alias("context_id"))
    asked = contexts.where("created_at IS NOT NULL").select((F.unix_micros("created_at") / 1e6).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("memory_id"), "context_id")
    both = stored.unionByName(asked).withColumn("h", _hour("t"))
    n, last = F.count("memory_id"), F.max(F.when(F.col("kind") == 0, F.struct("t", "memory_id")))
    hours = both.groupBy("h").agg(n.alias("n"), last.alias("last"))
    before = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("h", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.max("last").over(before).alias("last0"))
    same = Window.partitionBy("h").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({"n1": n.over(same), "last1": last.over(same)}).where("kind = 1").join(hours, "h")
    seen = seen.select("context_id", (F.col("n0") + F.col("n1")).alias("visible"), F.coalesce("last1", "last0").alias("last")).where("visible > 0")
    return seen.select("context_id", "visible", F.col("last.memory_id").alias("latest"))


@add(
    "asof_visible",
    f"""WITH {MEM}, ctx AS (SELECT context_id, epoch_us(created_at) / 1e6 AS t FROM contexts), b AS (SELECT context_id, t, memory_id, created_ts FROM ctx JOIN mem ON created_ts <= t)
    SELECT context_id, count(*)::bigint AS visible, arg_max(memory_id, (created_ts, memory_id)) AS latest FROM b GROUP BY context_id""",
)
def asof_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many memories existed when each context was asked, and the latest (as-of join)."""
    return visible_at(table(spark, sf_dir, "contexts"), memories(spark, sf_dir))


@add(
    "contains_join",
    """WITH a AS (SELECT item_id, answer FROM eval_items WHERE length(answer) >= 8) SELECT DISTINCT item_id, doc_id FROM a JOIN documents ON contains(text, answer)""",
)
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the answer of an evaluation item as a substring: one pass over the texts, which are never shuffled."""
    a = table(spark, sf_dir, "eval_items").where("length(answer) >= 8")
    return contains_any(table(spark, sf_dir, "documents"), "doc_id", "text", a, "item_id", "answer")


_SH = """sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 12)),
  ish AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items) WHERE len(w) >= 12))"""


def shingles(df: DataFrame, key: str, text: str, n: int = 12) -> DataFrame:
    """(key, pos, h): hashes of every run of n words, 0-based."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"), F.lit(1))
    w = df.select(key, words.alias("w")).where(F.size("w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))
    return w.select(key, F.posexplode(runs).alias("pos", "h"))


@add("shingle_overlap", f"WITH {_SH} SELECT doc_id, item_id, count(*)::bigint AS shared FROM sh JOIN ish USING (s) GROUP BY doc_id, item_id")
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-word runs that documents share with evaluation items, hashed so that texts aren't shuffled."""
    items = shingles(table(spark, sf_dir, "eval_items"), "item_id", "item_text").select("item_id", "h").distinct()
    docs = shingles(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "h")
    return docs.join(items.select("h").distinct(), "h", "left_semi").distinct().join(items, "h").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@add(
    "longest_run",
    """WITH d AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 12),
    ish AS (SELECT DISTINCT array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items) WHERE len(w) >= 12)),
    h AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM d WHERE array_to_string(w[i:i + 11], ' ') IN (SELECT s FROM ish)),
    r AS (SELECT doc_id, island, count(*) AS n FROM h GROUP BY ALL) SELECT doc_id, (max(n) + 11)::bigint AS words FROM r GROUP BY doc_id""",
)
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the longest quotation of evaluation material in each document (gaps and islands over matched runs)."""
    items = shingles(table(spark, sf_dir, "eval_items"), "item_id", "item_text").select("h").distinct()
    hits = shingles(table(spark, sf_dir, "documents"), "doc_id", "text").join(items, "h", "left_semi")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    runs = hits.withColumn("island", island).groupBy("doc_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id").agg((F.max("n") + 11).alias("words"))


@add(
    "similar_pairs",
    """WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.4e0""",
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of embeddings of one label at a cosine of 0.4 or more."""
    return vector.pairs_within(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.4)


#: Memories shown to a context.
SHOWN = 5


def _stream(slots: DataFrame, carry: bool) -> DataFrame:
    """(context_id, h, memory_id, m): the best memories before each asking row of a stream in order of (h, t, kind).

    `slots` has h, t, kind (0 memory, 1 asking), memory_id, m (frequency) and context_id, sorted within partitions. The
    state is the best so far, kept from hour to hour only with `carry`.
    """

    def run(batches):
        best, hour = [], None
        for pdf in batches:
            out = []
            for h, kind, memory_id, m, context_id in zip(*(pdf[c].tolist() for c in ("h", "kind", "memory_id", "m", "context_id"))):
                if h != hour:
                    best, hour = best if carry else [], h
                if kind:
                    out += [(context_id, h, i, -f) for f, i in best]
                elif len(best) < SHOWN or (-m, memory_id) < best[-1]:
                    best = sorted([*best, (-m, memory_id)])[:SHOWN]
            yield pd.DataFrame(out, columns=["context_id", "h", "memory_id", "m"])

    return slots.mapInPandas(run, "context_id long, h long, memory_id string, m long")


def shown_to(contexts: DataFrame, m: DataFrame) -> DataFrame:
    """(memory_id, shown, last_context) where each context is shown the memories of the highest frequency stored before it.

    A stream over one row an hour and its best memories finds the best of the hours before; a second one, sorted by time
    within the hours of contexts, starts from these. A task holds the best so far and no pair is ever built.
    """
    none = F.lit(None)
    asked = contexts.where("created_at IS NOT NULL").select("context_id", (F.unix_micros("created_at") / 1e6).alias("t"), F.lit(1).alias("kind"), none.cast("string").alias("memory_id"), F.lit(0).cast("long").alias("m"))
    asked = asked.withColumn("h", _hour("t"))
    # a missing frequency comes last
    stored = m.where("created_ts IS NOT NULL").select(F.lit(0).cast("long").alias("context_id"), F.col("created_ts").alias("t"), F.lit(0).alias("kind"), "memory_id", F.coalesce("frequency", F.lit(-(1 << 62))).alias("m"))
    stored = stored.withColumn("h", _hour("t"))
    hours = asked.select("h").distinct()
    best = Window.partitionBy("h").orderBy(F.desc("m"), "memory_id")
    five = stored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= SHOWN).drop("rn")
    # asking rows come first in their hour, so they see the hours before only
    asks = hours.select(F.lit(0).cast("long").alias("context_id"), F.lit(float("-inf")).alias("t"), F.lit(1).alias("kind"), none.cast("string").alias("memory_id"), F.lit(0).cast("long").alias("m"), "h")
    before = _stream(five.unionByName(asks).repartition(1).sortWithinPartitions("h", "t", "kind"), True)
    before = before.withColumns({"t": F.lit(float("-inf")), "kind": F.lit(0)})
    slots = before.unionByName(stored.join(hours, "h", "left_semi")).unionByName(asked)
    shown = _stream(slots.repartition("h").sortWithinPartitions("h", "t", "kind"), False)
    return shown.groupBy("memory_id").agg(F.count("*").alias("shown"), F.max("context_id").alias("last_context"))


@add(
    "open_loop_feedback",
    f"""WITH {MEM}, q AS (SELECT context_id, epoch_us(created_at) / 1e6 AS t FROM contexts), v AS (SELECT q.context_id, memory_id, frequency, row_number() OVER (PARTITION BY q.context_id ORDER BY frequency DESC NULLS LAST, memory_id) AS rn
      FROM q JOIN mem ON created_ts <= t) SELECT memory_id, count(*)::bigint AS shown, max(context_id)::bigint AS last_context FROM v WHERE rn <= 5 GROUP BY memory_id""",
)
def open_loop_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each memory is among the five shown, when what is shown depends only on what was stored before."""
    return shown_to(table(spark, sf_dir, "contexts"), memories(spark, sf_dir))
