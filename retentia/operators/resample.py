"""Two-stage clustered bootstrap: whole clusters are drawn, then the items within each drawn cluster.

Every replicate weighs a cluster by a Poisson(1) draw and each of its items by a Poisson draw of that mean. Rows meet
as counts of equal (cluster, value) first, and what a task sends is one partial sum a replicate; rows are never copied.
Draws come from a generator keyed by seed, cluster and value, so they don't depend on partitions or on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Replicates that a task of `auroc_replicates` carries through all rows, and clusters whose draws a task remembers.
BLOCK, REMEMBERED = 250, 4096


def generator(*key: object) -> np.random.Generator:
    digest = hashlib.blake2b("\0".join(map(repr, key)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


class ClusterDraws:
    """Poisson(1) draws of each cluster, the last ones remembered."""

    def __init__(self, n: int, *key: object):
        self.n, self.key, self.known = n, key, {}

    def __getitem__(self, cluster: object) -> np.ndarray:
        w = self.known.get(cluster)
        if w is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            w = self.known[cluster] = generator("cluster", *self.key, cluster).poisson(1.0, self.n)
        return w


def mean_replicates(df: DataFrame, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean). Items count as deviations from their cluster's mean, so a cluster of one item has no variance
    of its own, as when items are drawn with replacement."""
    x = df.select(F.col(cluster).cast("string").alias("c"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    counts = x.groupBy("c", "v").agg(F.count("*").alias("n"))
    centre = counts.groupBy("c").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).withColumnRenamed("c", "cc")
    rows = counts.join(centre, F.col("c").eqNullSafe(F.col("cc"))).select("c", "v", "n", "m")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(replicates), np.zeros(replicates)
        draws = ClusterDraws(replicates, seed)
        for batch in batches:
            for c, v, n, m in zip(*(batch.column(k).to_pylist() for k in ("c", "v", "n", "m"))):
                w = draws[c] * n
                weight += w
                total += w * m
                if v != m:
                    total += generator("item", seed, c, v).poisson(w) * (v - m)
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array(total), pa.array(weight)], ["replicate", "total", "weight"])

    sums = rows.mapInArrow(draw, "replicate int, total double, weight double").groupBy("replicate").agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    return sums.where("w > 0").select("replicate", (F.col("t") / F.col("w")).alias("mean"))


def cell_replicates(df: DataFrame, cluster: str, cells: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, cells, n): how often each combination of `cells` (booleans) is drawn in each replicate."""
    counts = df.groupBy(F.col(cluster).cast("string").alias("c"), *cells).agg(F.count("*").alias("n"))
    for cell in cells:
        counts = counts.where(F.col(cell).isNotNull())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        draws = ClusterDraws(replicates, seed)
        for batch in batches:
            for c, n, *own in zip(*(batch.column(k).to_pylist() for k in ("c", "n", *cells))):
                drawn = generator("cell", seed, c, *own).poisson(draws[c] * n)
                total[tuple(own)] = total.get(tuple(own), 0) + drawn
        for own, n in total.items():
            arrays = [pa.array(range(replicates), pa.int32()), *(pa.array([x] * replicates, pa.bool_()) for x in own), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["replicate", *cells, "n"])

    schema = ", ".join(["replicate int", *(f"{c} boolean" for c in cells), "n long"])
    return counts.mapInArrow(draw, schema).groupBy("replicate", *cells).agg(F.sum("n").alias("n"))


def auroc_replicates(df: DataFrame, cluster: str, scores: list[str], label: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, one column of AUROC a score), all scores under the same draws; replicates of one class are left out.

    Blocks of replicates are tasks that stream the counts in order of a score and hold one number a replicate.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(cluster).cast("string").alias("c"), *(F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)), F.col(label).alias("y"))
    counts = counts.agg(F.count("*").alias("n"))
    blocks = -(-replicates // BLOCK)
    values = [f"s{i}" for i in range(len(scores))]

    def run(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, size, draws, value = -1, 0, None, None
            won = below = pos = neg = n_pos = None

            def step() -> None:
                nonlocal won, below, pos, neg
                won, below = won + pos * (below + neg / 2.0), below + neg
                pos, neg = np.zeros(size), np.zeros(size)

            def finish() -> Iterator[pa.RecordBatch]:
                step()
                good = (n_pos > 0) & (below > 0)
                at = np.flatnonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array((now * BLOCK + at).astype(np.int32)), pa.array(won[at] / (n_pos[at] * below[at]))], ["replicate", name])

            for batch in batches:
                for block, c, y, n, v, *all_ in zip(*(batch.column(k).to_pylist() for k in ("block", "c", "y", "n", name, *values))):
                    if block != now:
                        if now >= 0:
                            yield from finish()
                        now, size, value = block, min(BLOCK, replicates - block * BLOCK), v
                        draws = ClusterDraws(size, seed, block)
                        won, below, pos, neg, n_pos = (np.zeros(size) for _ in range(5))
                    if v != value:
                        step()
                        value = v
                    drawn = generator("item", seed, block, c, y, *all_).poisson(draws[c] * n)
                    if y:
                        pos += drawn
                        n_pos += drawn
                    else:
                        neg += drawn
            if now >= 0:
                yield from finish()

        return scan

    spread = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = None
    for s, name in zip(scores, values):
        one = spread.repartition(blocks, "block").sortWithinPartitions("block", name).mapInArrow(run(name), f"replicate int, {name} double").withColumnRenamed(name, s)
        out = one if out is None else out.join(one, "replicate")
    return out


def interval(df: DataFrame, value: str, digits: int = 6) -> list:
    """Columns low and high of the central 95 % of a column of replicates."""
    return [F.round(F.percentile(value, p), digits).alias(name) for p, name in ((0.025, "low"), (0.975, "high"))]


def two_sided(value: str):
    """Two-sided bootstrap p of a difference."""
    share = lambda c: F.avg(c.cast("int"))
    return F.least(F.lit(1.0), 2 * F.least(share(F.col(value) <= 0), share(F.col(value) >= 0)))
