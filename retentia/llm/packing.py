"""Filling fixed-capacity containers with whole items.

Method: vector best-fit. A container has three capacities: tokens, documents and attention cost (the sum of squared
lengths). Items go in by falling size; each goes to the container, among those with room in every capacity, whose
weighted residual vector is shortest once the item is in, or to a new one.

Every task packs the rows of its own input partition in groups of bounded size, without a shuffle, so a hot key means
nothing. What stands in containers that a group left part-filled (narrow rows, about a container a group) is then
packed once more across groups; between the two steps the narrow result is written to the shared checkpoint folder, so
a lost task cannot number a container twice.

Defined results: an item larger than the token capacity is cut into full containers and a rest, nothing else is cut; an
item whose own attention cost exceeds that capacity takes all of it and shares its container only with items of none;
null or negative sizes count as 0 and are placed; repeated ids are placed once per row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.session import checkpointed

#: Items packed together in a task, and the share of its tokens that a container may leave free and still be closed.
GROUP_ROWS, SLACK = 8192, 0.005


def best_fit(sizes: np.ndarray, tokens: int, docs: int, attention: float, weights: tuple[float, float, float]) -> np.ndarray:
    """Container number of each item (each within the capacities on its own), filled by falling size."""
    capacity = np.array([tokens, docs, attention], dtype=np.float64)
    scale = np.sqrt(np.array(weights)) / capacity
    place = np.full(len(sizes), -1, dtype=np.int64)
    room = np.empty((len(sizes), 3))
    number = np.empty(len(sizes), dtype=np.int64)
    open_, made = 0, 0
    order = np.argsort(-sizes, kind="stable")
    smallest = np.minimum.accumulate(sizes[order][::-1])[::-1] if len(sizes) else sizes
    for step, i in enumerate(order):
        need = np.array([sizes[i], 1.0, min(float(sizes[i]) ** 2, capacity[2])])
        left = room[:open_] - need
        fits = (left >= 0).all(axis=1)
        if fits.any():
            norm = np.where(fits, ((left * scale) ** 2).sum(axis=1), np.inf)
            best = int(norm.argmin())
        else:
            best = open_
            room[best] = capacity
            number[best] = made
            open_, made = open_ + 1, made + 1
        room[best] -= need
        place[i] = number[best]
        if room[best, 1] < 1 or room[best, 0] < smallest[min(step + 1, len(order) - 1)]:
            open_ -= 1
            room[best], number[best] = room[open_], number[open_]
    return place


def pack_containers(
    df: DataFrame,
    item: Column,
    size: Column,
    tokens: int = 1024,
    docs: int = 1024,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(container_id, item_id, piece_no, start_token, n_tokens): every item whole in one container, oversized ones in several.

    `attention` defaults to the square of `tokens`. A `container_id` is step, partition, group and number in the group.
    """
    cost = float(tokens) ** 2 if attention is None else float(attention)
    if docs < 1 or cost <= 0:
        raise ValueError("a container must hold a document")
    slim = df.select(item.alias("item_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    ids = slim.schema["item_id"].dataType
    columns = [T.StructField("item_id", ids), *(T.StructField(c, T.LongType()) for c in ("piece_no", "start_token", "n_tokens"))]
    schema = T.StructType([T.StructField("container_id", T.StringType()), *columns, T.StructField("open", T.BooleanType())])

    def placed(t: pa.Table, n: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
        """The rows of `t` (item_id, piece_no, start_token, n_tokens) with their containers; `open` where one is part-filled."""
        place = best_fit(n, tokens, docs, cost, weights)
        used = np.bincount(place, weights=n, minlength=1)
        number = pa.array([f"{name}-{k}" for k in place.tolist()], pa.string())
        part_filled = pa.array(used[place] < tokens * (1 - SLACK)) if len(place) else pa.array([], pa.bool_())
        yield from pa.table([number, *t.columns, part_filled], schema.names).combine_chunks().to_batches()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for group, t in enumerate(grouped(batches, group_rows)):
            size_ = t["size"].to_numpy()
            whole, rest = size_ // tokens, size_ % tokens
            row_full = np.repeat(np.arange(len(size_)), whole)
            nth = np.arange(len(row_full)) - np.repeat(np.cumsum(whole) - whole, whole)
            number = pa.array([f"f-{part}-{group}-{k}" for k in range(len(row_full))], pa.string())
            full = [t["item_id"].take(pa.array(row_full)), pa.array(nth), pa.array(nth * tokens), pa.array(np.full(len(nth), tokens, dtype=np.int64))]
            yield from pa.table([number, *full, pa.array(np.zeros(len(nth), dtype=bool))], schema.names).combine_chunks().to_batches()
            rows = np.flatnonzero((rest > 0) | (whole == 0))
            left = pa.table([t["item_id"].take(pa.array(rows)), pa.array(whole[rows]), pa.array(whole[rows] * tokens), pa.array(rest[rows])], schema.names[1:5])
            yield from placed(left, rest[rows], f"a-{part}-{group}")

    def refill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for group, t in enumerate(grouped(batches, group_rows)):
            yield from placed(t, t["n_tokens"].to_numpy(), f"b-{part}-{group}")

    first = checkpointed(slim.mapInArrow(fill, schema))
    again = first.where("open").drop("open")
    n_groups = max(1, -(-again.count() // group_rows))
    # the order in a partition decides the containers, so it is fixed whatever order the shuffle brings
    gathered = again.repartition(n_groups, "container_id").sortWithinPartitions("container_id", "piece_no", "n_tokens", "item_id").drop("container_id")
    second = gathered.mapInArrow(refill, schema)
    return first.where("NOT open").drop("open").unionByName(second.drop("open"))


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of `rows` rows each, the last with what is left."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - count, batch.num_rows - at)
            held.append(batch.slice(at, take))
            at, count = at + take, count + take
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
