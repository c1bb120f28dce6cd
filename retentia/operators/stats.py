"""Rank statistics as aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midranks(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Adds midrank (average rank of equals, from 1) within `group`.

    Equal values are counted first and only the counts are summed up in order, so ties cost nothing and a group is as
    large in a task as it has different values.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn("midrank", F.sum("__n").over(w) - (F.col("__n") - 1) / 2.0).drop("__n")
    return df.join(ranks, [*group, value])


def auroc(df: DataFrame, score: str, label: str, group: list[str]) -> DataFrame:
    """(group, auc, n_pos, n_neg) by the Mann-Whitney count with ties; null with one class only.

    From (score, class) counts: a positive beats all negatives below its score and half of those at it.
    """
    c = df.groupBy(*group, score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("__p"), F.sum(F.when(F.col(label), 0).otherwise(1)).alias("__q"))
    w = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__below", F.coalesce(F.sum("__q").over(w), F.lit(0)))
    g = c.groupBy(*group).agg(F.sum(F.col("__p") * (F.col("__below") + F.col("__q") / 2.0)).alias("u"), F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(F.col("u") / (F.col("n_pos") * F.col("n_neg")), 6))
    return g.select(*group, auc.alias("auc"), "n_pos", "n_neg")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with Cohen's kappa of two raters over any number of classes; 1 where chance agreement is complete."""
    n = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("N"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left, right = n.groupBy("x").agg(F.sum("n").alias("nx")), n.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, "x").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("e"))
    po, pe = F.col("same") / F.col("N"), F.col("e") / (F.col("N") * F.col("N"))
    k = F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (F.lit(1.0) - pe))
    return total.crossJoin(chance).select(F.round(k, 6).alias("kappa"), F.col("N").alias("n"))


def holm(df: DataFrame, key: str, p: str, family: str) -> DataFrame:
    """Step-down adjusted p values within each family."""
    m = F.count("*").over(Window.partitionBy(family))
    rk = F.row_number().over(Window.partitionBy(family).orderBy(p, key))
    w = Window.partitionBy(family).orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0)
    stepped = df.withColumn("__q", F.least(F.lit(1.0), (m - rk + 1) * F.col(p)))
    return stepped.withColumn("adjusted", F.round(F.max("__q").over(w), 9)).drop("__q")


def binomial_half_tail(k: int, n: int) -> float:
    """P(X <= k) of a binomial of n fair throws: whole sums for few, terms by logarithms for many."""
    if n <= 1000:
        return sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0))
    total, i = 0.0, k
    while term > total * 1e-17 and i >= 0:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return total


def mcnemar_p(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided p of the discordant counts; 1 where there are none."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        one = lambda x, y: None if x is None or y is None else 1.0 if x + y == 0 else min(1.0, 2.0 * binomial_half_tail(int(min(x, y)), int(x + y)))
        return pd.Series([one(x, y) for x, y in zip(a.tolist(), b.tolist())], dtype="float64")

    return p(a_only, b_only)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal, by a Chebyshev form of erfc good to 1.2e-7 of its value (fixed coefficients)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        series = F.lit(c) + t * series
    return t * F.exp(-x * x - F.lit(1.26551223) + t * series)


def format_p(p: Column, resolution: float) -> Column:
    """A p value to three digits; one below what the test can resolve is given as less than that, never as 0."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else f"< {resolution:.0e}" if v < resolution else f"{v:.3g}" for v in values.tolist()], dtype=object)

    return text(p)


def known_answer(got: float, expected: float, within: float = 5e-4) -> bool:
    """Whether a result is the published one."""
    return abs(got - expected) <= within


#: Weightings whose counts a task holds, and rows it gathers before it counts them.
BLOCK_WEIGHTS, BLOCK_ROWS = 11, 1 << 20


def auroc_of_weights(df: DataFrame, values: list[str], label: str, names: list[str], configs: list[tuple[tuple, tuple]], block: int = BLOCK_WEIGHTS, clip: bool = False) -> DataFrame:
    """(names, auc, n_pos, n_neg): AUROC of each configuration's weighted sum of `values` at six decimals, with `clip`
    bounded by 0 and 1; auc isn't rounded.

    A configuration is (what `names` say of it, its weights). Rows carry only numbers and go to one task a block of
    configurations, which streams them and holds counts of different sums: at most about 2,000,002 a configuration where
    sums are between 0 and 1, however many rows there are.
    """
    blocks = [configs[i : i + block] for i in range(0, len(configs), block)]
    x = df.where(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(values)), F.col(label).alias("y"))
    x = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))
    schema = ", ".join([*(f"{n} double" for n in names), "auc double, n_pos long, n_neg long"])

    def rows(block: int, counted: list) -> pa.RecordBatch:
        out = [(*said, *_auc(*one)) for (said, _), one in zip(blocks[block], counted)]
        return pa.RecordBatch.from_pylist([dict(zip([*names, "auc", "n_pos", "n_neg"], r)) for r in out], pa.schema([*((n, pa.float64()) for n in [*names, "auc"]), ("n_pos", pa.int64()), ("n_neg", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counted, held, n_held = None, [], [], 0

        def count() -> None:
            nonlocal held, n_held
            if held:
                cols, y = [np.concatenate(c) for c in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held])
                counted[:] = [_merge(one, _codes(cols, y, w, clip)) for one, (_, w) in zip(counted, blocks[now])]
                held, n_held = [], 0

        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            cols = [batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(values))]
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if block[a] != now:
                    count()
                    if now is not None:
                        yield rows(now, counted)
                    now = int(block[a])
                    counted = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(blocks[now])
                held.append(([c[a:b] for c in cols], y[a:b]))
                n_held += b - a
                if n_held >= BLOCK_ROWS:
                    count()
        count()
        if now is not None:
            yield rows(now, counted)

    return x.repartition(len(blocks), "block").sortWithinPartitions("block").mapInArrow(scan, schema)


def millionths(cols: list, weights: tuple, clip: bool) -> np.ndarray:
    """Weighted sum of columns, from left to right, in whole millionths; NaN is the largest."""
    v = weights[0] * cols[0]
    for w, c in zip(weights[1:], cols[1:]):
        v = v + w * c
    if clip:
        v = np.clip(v, 0.0, 1.0)
    k = np.floor(np.abs(v) * 1e6 + 0.5) * np.sign(v)
    return np.clip(np.nan_to_num(k, nan=1e15), -1e15, 1e15).astype(np.int64)


def _codes(cols: list, y: np.ndarray, weights: tuple, clip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Different (2 x sum in millionths + label), ascending, and how often each occurs."""
    return np.unique(2 * millionths(cols, weights, clip) + y, return_counts=True)


def _merge(a: tuple, b: tuple) -> tuple:
    code, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=code[:1] - 1))
    return (code[first], np.add.reduceat(n, first)) if len(code) else (code, n)


def _auc(code: np.ndarray, n: np.ndarray) -> tuple:
    pos = (code & 1).astype(bool)
    neg = np.where(pos, 0, n)
    equal = np.where(np.diff(code, prepend=code[:1] - 2) == 1, np.roll(neg, 1), 0)
    n_pos, n_neg = int(n[pos].sum()), int(neg.sum())
    u = float((n * (np.cumsum(neg) - equal / 2))[pos].sum())
    return (u / (n_pos * n_neg) if n_pos and n_neg else None, n_pos, n_neg)


def harm_of_weights(df: DataFrame, group: str, tie: str, values: list[str], needed: str, names: list[str], configs: list[tuple[tuple, tuple]], keep: float) -> DataFrame:
    """(names, harm): mean share of a group's needed rows that keeping its ceil(keep x n) best rows loses, by configuration.

    Sums are at six decimals and bounded by 0 and 1, ties in order of `tie`; groups without a needed row don't count. A
    group's numbers are held in one task; a task sends one partial sum a configuration.
    """
    x = df.select(F.col(group).alias("g"), F.col(tie).alias("tie"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(values)), F.col(needed).alias("y"))
    weights = [np.array(c)[:, None] for c in zip(*(w for _, w in configs))]
    cells = 1 << 22

    def lost(cols: list, y: np.ndarray) -> np.ndarray:
        n, out = len(y), []
        kept, order = max(1, math.ceil(keep * n)), np.arange(n)
        step = max(1, cells // n)
        for i in range(0, len(configs), step):
            key = millionths([c[None, :] for c in cols], [w[i : i + step] for w in weights], True) * n - order
            bar = np.partition(key, n - kept, axis=1)[:, n - kept, None]
            out.append(((key < bar) & y[None, :]).sum(axis=1))
        return np.concatenate(out) / y.sum()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, groups, now, held = np.zeros(len(configs)), 0, scan, []  # no group is called `scan`

        def close() -> None:
            nonlocal total, groups, held
            if held:
                cols, y = [np.concatenate(c) for c in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held])
                if y.any():
                    total, groups = total + lost(cols, y), groups + 1
                held = []

        for batch in batches:
            g = batch.column("g").to_pylist()
            cols = [batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(values))]
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(i for i in range(1, len(g)) if g[i] != g[i - 1]), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if g[a] != now:
                    close()
                    now = g[a]
                held.append(([c[a:b] for c in cols], y[a:b]))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(configs)), pa.int32()), pa.array(total), pa.array([groups] * len(configs), pa.int64())], ["nth", "total", "groups"])

    parts = x.repartition("g").sortWithinPartitions("g", "tie").mapInArrow(scan, "nth int, total double, groups long")
    sums = parts.groupBy("nth").agg((F.sum("total") / F.sum("groups")).alias("harm"))
    said = df.sparkSession.createDataFrame([(i, *map(float, s)) for i, (s, _) in enumerate(configs)], ", ".join(["nth int", *(f"{n} double" for n in names)]))
    return sums.join(F.broadcast(said), "nth").select(*names, "harm")
