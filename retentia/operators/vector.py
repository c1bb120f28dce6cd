"""Exact vector search of a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries compared in one pass over the memories.
BLOCK_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def knn(queries: DataFrame, qid: str, qvec: str, memories: DataFrame, mid: str, mvec: str, k: int, metric: str = "cosine", dim: int = 64) -> DataFrame:
    """(qid, mid, sim, sim_rank): the k best memories of each query, ties by id; sim at six decimals.

    Queries come in blocks of bounded size; every task keeps k rows a query, so memories are never shuffled. For
    `euclid` sim is the negated distance. Vectors that are null or of another length play no part.
    """
    if metric not in ("cosine", "dot", "euclid"):
        raise ValueError(f"unknown metric {metric}")
    wanted = queries.where(F.size(qvec) == dim).select(F.col(qid).alias("q"), F.col(qvec).cast("array<double>").alias("v"))
    n_blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))
    slim = memories.where(F.size(mvec) == dim).select(F.col(mid).alias("m"), F.col(mvec).cast("array<double>").alias("v"))
    q_type, m_type = wanted.schema["q"].dataType, slim.schema["m"].dataType
    schema = T.StructType([T.StructField("q", q_type), T.StructField("m", m_type), T.StructField("sim", T.DoubleType())])
    found = None
    for block in range(n_blocks):
        part = wanted.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).toArrow()
        one = slim.mapInArrow(_scanner(part["q"].combine_chunks(), _matrix(part["v"], dim), k, metric, dim), schema)
        found = one if found is None else found.unionByName(one)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "m"))
    ranked = found.withColumn("sim", F.round("sim", 6)).withColumn("sim_rank", best).where(F.col("sim_rank") <= k)
    return ranked.select(F.col("q").alias(qid), F.col("m").alias(mid), "sim", "sim_rank")


def nearer(queries: DataFrame, qid: str, qvec: str, bar: str, memories: DataFrame, mvec: str, dim: int = 64) -> DataFrame:
    """(qid, n): how many memories have a cosine, at six decimals, above each query's `bar`; a task gives one count a query."""
    wanted = queries.where(F.size(qvec) == dim).select(F.col(qid).alias("q"), F.col(qvec).cast("array<double>").alias("v"), F.col(bar).alias("bar"))
    n_blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))
    slim = memories.where(F.size(mvec) == dim).select(F.col(mvec).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("q", wanted.schema["q"].dataType), T.StructField("n", T.LongType())])
    found = None
    for block in range(n_blocks):
        part = wanted.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).toArrow()
        one = slim.mapInArrow(_counter(part["q"].combine_chunks(), _matrix(part["v"], dim), part["bar"].to_numpy(), dim), schema)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("q").agg(F.sum("n").alias("n")).select(F.col("q").alias(qid), "n")


def _counter(ids: pa.Array, q: np.ndarray, bar: np.ndarray, dim: int):
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    norms = np.linalg.norm(q, axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(q), dtype=np.int64)
        for batch in batches:
            if batch.num_rows and len(q):
                n += (_cosines(q, norms, _matrix(batch.column("v"), dim)) > bar[:, None]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n)], ["q", "n"])

    return count


def _cosines(q: np.ndarray, norms: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines at six decimals, 0 where a vector is all zero."""
    scale = norms[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return six(np.divide(q @ x.T, scale, out=np.zeros_like(scale), where=scale > 0))


def six(s: np.ndarray) -> np.ndarray:
    return np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 * np.sign(s)


#: Vectors of a block of `pairs_within`.
BLOCK_PAIRS = 2048


def pairs_within(df: DataFrame, group: str, key: str, vec: str, least: float) -> DataFrame:
    """(a, b, cos): all pairs a < b of a group at a cosine of `least` or more, cos at six decimals.

    A group is divided into blocks by a hash of the key and every pair of blocks is compared in a group of its own, so a
    task holds two blocks whatever the size of the group. Null vectors and groups play no part, nor pairs of unlike length.
    """
    e = df.where(F.col(vec).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.size(vec).alias("dim"), F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"))
    blocks = e.groupBy("g", "dim").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_PAIRS))).cast("int").alias("n"))
    e = e.join(F.broadcast(blocks), ["g", "dim"]).withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    e = e.select("g", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "v")
    kind = e.schema["k"].dataType

    def compare(table: pa.Table) -> pa.Table:
        dim, own = table["dim"][0].as_py(), table["own"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x, keys = _matrix(table["v"], dim), table["k"].combine_chunks()
        norms = np.linalg.norm(x, axis=1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ids = np.array(keys.to_pylist(), dtype=object)
        a, b, c = [], [], []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            scale = norms[rows][:, None] * norms[right][None, :]
            s = np.divide(x[rows] @ x[right].T, scale, out=np.zeros_like(scale), where=scale > 0)
            p, q = np.nonzero(s >= least)
            one, two = rows[p], right[q]
            keep = (ids[one] < ids[two]) if i == j else (ids[one] != ids[two])
            one, two, s = one[keep], two[keep], s[p, q][keep]
            swap = ids[one] > ids[two]
            a.append(np.where(swap, two, one))
            b.append(np.where(swap, one, two))
            c.append(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 * np.sign(s))
        take = lambda parts: keys.take(pa.array(np.concatenate(parts) if parts else np.empty(0, int)))
        return pa.table({"a": take(a), "b": take(b), "cos": np.concatenate(c) if c else np.empty(0)})

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cos", T.DoubleType())])
    return e.groupBy("g", "dim", "i", "j").applyInArrow(compare, schema)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scanner(queries: pa.Array, q: np.ndarray, k: int, metric: str, dim: int):
    norms = np.linalg.norm(q, axis=1)
    queries = queries.combine_chunks() if isinstance(queries, pa.ChunkedArray) else queries
    ids = queries.to_pylist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        kind = None
        for batch in batches:
            kind = batch.schema.field("m").type
            if not batch.num_rows or not len(ids):
                continue
            x, keys = _matrix(batch.column("v"), dim), batch.column("m").to_pylist()
            s = q @ x.T
            if metric == "cosine":
                scale = norms[:, None] * np.linalg.norm(x, axis=1)[None, :]
                s = np.divide(s, scale, out=np.zeros_like(s), where=scale > 0)
            elif metric == "euclid":
                s = -np.sqrt(np.maximum((x**2).sum(axis=1)[None, :] + (q**2).sum(axis=1)[:, None] - 2 * s, 0))
            s = np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 * np.sign(s)
            for i, row in enumerate(s):
                top = range(len(row))
                if len(row) > k:
                    bar = np.partition(row, len(row) - k)[len(row) - k]
                    top = np.flatnonzero(row >= bar).tolist()
                rows = best[i] + [(row[j], keys[j]) for j in top]
                best[i] = sorted(rows, key=lambda t: (-t[0], t[1]))[:k]
        rows = [(ids[i], m, s) for i, own in enumerate(best) for s, m in own]
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, queries.type), pa.array(b, kind), pa.array(c, pa.float64())], ["q", "m", "sim"])

    return scan
