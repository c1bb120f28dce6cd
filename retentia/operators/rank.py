"""Rank fusion over candidates (query, memory, sim, sim_rank, s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, ALPHA, MIN_SPREAD = 60, 0.5, 0.05


def score_rank(query: str = "qid", score: str = "s") -> Column:
    """Rank by score; ties keep the order of similarity."""
    return F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), "sim_rank"))


def fused(mode: str, query: str = "qid", k: int = RRF_K, beta_sim: float = 1.0, beta_score: float = 1.0, alpha: float = ALPHA) -> Column:
    """Fused value of a candidate with sim, sim_rank, s, s_rank.

    Modes: similarity, rrf, wrrf (weighted), blend (similarity normalised within the query, 1 where it hardly varies).
    """
    w = Window.partitionBy(query)
    if mode == "similarity":
        return -F.col("sim_rank").cast("double")
    if mode == "rrf":
        beta_sim = beta_score = 1.0
    if mode in ("rrf", "wrrf"):
        return F.lit(beta_sim) / (F.lit(float(k)) + F.col("sim_rank")) + F.lit(beta_score) / (F.lit(float(k)) + F.col("s_rank"))
    if mode == "blend":
        low, high = F.min("sim").over(w), F.max("sim").over(w)
        norm = F.when(high - low < MIN_SPREAD, F.lit(1.0)).otherwise((F.col("sim") - low) / (high - low))
        return F.lit(alpha) * norm + F.lit(1.0 - alpha) * F.col("s")
    raise ValueError(f"unknown mode {mode}")


def rerank(candidates: DataFrame, mode: str, top_n: int | None = None, query: str = "qid", **options: float) -> DataFrame:
    """Candidates with s_rank, fused and pos (1 is best), cut at `top_n`; ties keep the order of similarity."""
    ranked = candidates.withColumn("s_rank", score_rank(query))
    ranked = ranked.withColumn("fused", F.round(fused(mode, query, **options), 9))
    pos = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("fused"), "sim_rank"))
    ranked = ranked.withColumn("pos", pos)
    return ranked if top_n is None else ranked.where(F.col("pos") <= top_n)


def extended(ranked: DataFrame, fetch_k: int) -> DataFrame:
    """Final positions where only the first `fetch_k` by similarity are reranked and the rest keep their order."""
    return ranked.withColumn("pos", F.when(F.col("sim_rank") <= fetch_k, F.col("pos")).otherwise(F.col("sim_rank")))


def within_budget(ranked: DataFrame, cost: Column, budget: int, query: str = "qid", pos: str = "pos") -> DataFrame:
    """The longest prefix of each query's ranking whose costs sum to `budget` or less."""
    w = Window.partitionBy(query).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


#: Parts into which a group's keys are divided for `rank_within`.
PARTS = 64


def rank_within(df: DataFrame, group: list[str], key: str, tie: str, name: str = "place", size: str = "n") -> DataFrame:
    """Adds the place (from 1) of each row in its group by (key, tie) ascending, and the group's size.

    No task ever holds a group: approximate quantiles of `key` divide it into parts, rows on a quantile are divided
    again by the first two characters of `tie` (a string, best a hash), rows are numbered within parts, and the sizes
    of the parts before are added. Null keys come first; rows equal in both are in any order.
    """
    cuts = [i / PARTS for i in range(1, PARTS)]
    quantiles = df.groupBy(*group).agg(F.array_distinct(F.percentile_approx(key, cuts, 2000)).alias("__cuts"))
    marked = _same_group(df, quantiles, group)
    cut = F.coalesce("__cuts", F.array().cast(quantiles.schema["__cuts"].dataType))
    below = F.size(F.filter(cut, lambda c: c < F.col(key)))
    on = F.array_contains(cut, F.col(key))
    marked = marked.withColumns(
        {
            # keys between two cuts, then the keys on the next cut
            "__part": F.when(F.col(key).isNull(), F.lit(-1)).otherwise(below * 2 + F.when(on, 1).otherwise(0)),
            "__sub": F.when(on | F.col(key).isNull(), F.substring(tie, 1, 2)).otherwise(F.lit("")),
        }
    ).drop("__cuts")
    parts = marked.groupBy(*group, "__part", "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), size: F.sum("__n").over(Window.partitionBy(*group))}).drop("__n")
    nth = F.row_number().over(Window.partitionBy(*group, "__part", "__sub").orderBy(key, tie))
    placed = _same_group(marked.withColumn("__nth", nth), parts, [*group, "__part", "__sub"])
    return placed.withColumn(name, F.col("__nth") + F.col("__before")).drop("__part", "__sub", "__nth", "__before")


def _same_group(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which nulls are equal."""
    renamed = other.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    same = None
    for k in keys:
        one = df[k].eqNullSafe(renamed[f"__g_{k}"])
        same = one if same is None else same & one
    if same is None:
        return df.crossJoin(F.broadcast(other))
    return df.join(renamed, same).drop(*(f"__g_{k}" for k in keys))
