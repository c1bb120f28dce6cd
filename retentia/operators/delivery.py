"""One row per identifier out of at-least-once deliveries.

Method: exact quotient hash tables. Each identifier is encoded in whole 32-byte words and permuted by an invertible
mix, so that equal encodings and only those stay equal. The leading bits of the permuted identifier (the quotient)
name a shard, the shard's table stores the complete rest of it (the remainder), and a probe compares whole
remainders: an identifier is inserted once and no two identifiers are ever taken for one another.

Defined results: null and blank identifiers never count and give no row; letter case and surrounding blanks are
ignored; repeated rows count as deliveries; of an identifier's rows the first by the caller's order is kept, with
all its columns whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.session import partitions_for

#: Blanks that may surround an identifier.
BLANKS = " \t\n\r\f\v "
#: Identifiers in one shard's table, on average, without and with the other columns; a shard is held in memory at once.
SHARD_ROWS, WIDE_ROWS = 1 << 15, 1 << 12
#: Bytes of one identifier word.
WORD = 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def canonical_id(column: Column) -> Column:
    """Trimmed lower-case identifier; null where missing or blank."""
    trimmed = F.lower(F.btrim(column.cast("string"), F.lit(BLANKS)))
    return F.when(trimmed != "", trimmed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def permute(words: np.ndarray) -> np.ndarray:
    """Bijection on rows of 64-bit words: each word in turn is moved by a mix of all the others."""
    out = words.copy()
    width = out.shape[1]
    with np.errstate(over="ignore"):
        for step in range(2 * width):
            j = step % width
            moved = np.full(len(out), np.uint64(step + 1))
            for i in range(width):
                if i != j:
                    moved = _mix(moved + out[:, i])
            out[:, j] += moved
    return out


def unpermute(words: np.ndarray) -> np.ndarray:
    """Inverse of `permute`."""
    out = words.copy()
    width = out.shape[1]
    with np.errstate(over="ignore"):
        for step in reversed(range(2 * width)):
            j = step % width
            moved = np.full(len(out), np.uint64(step + 1))
            for i in range(width):
                if i != j:
                    moved = _mix(moved + out[:, i])
            out[:, j] -= moved
    return out


def encode_ids(ids: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, words) by encoded width. Sixty-four lower-case hex digits become their 32 bytes, any other
    identifier its UTF-8 bytes behind their length, zero-padded to 64 bytes or more; the encoding is one-to-one."""
    by_width: dict[int, tuple[list[int], list[bytes]]] = {}
    for row, text in enumerate(ids):
        raw = None
        if len(text) == 64:
            try:
                raw = bytes.fromhex(text) if text == text.lower() else None
            except ValueError:
                raw = None
        if raw is None or len(raw) != 32:
            data = text.encode("utf-8", "surrogatepass")
            raw = len(data).to_bytes(8, "little") + data
            raw += b"\0" * (-len(raw) % WORD)
            if len(raw) == WORD:
                raw += b"\0" * WORD
        rows, parts = by_width.setdefault(len(raw), ([], []))
        rows.append(row)
        parts.append(raw)
    return [
        (np.array(rows, dtype=np.int64), np.frombuffer(b"".join(parts), dtype="<u8").reshape(len(rows), width // 8))
        for width, (rows, parts) in by_width.items()
    ]


class QuotientTable:
    """Open-addressing table of complete remainders; rows are inserted in order and the first of equals stays."""

    def __init__(self, width: int, capacity: int):
        size = 1 << max(4, math.ceil(math.log2(max(1, capacity) * 2)))
        self.mask = np.uint64(size - 1)
        self.used = np.zeros(size, dtype=bool)
        self.rest = np.zeros((size, width), dtype=np.uint64)
        self.count = np.zeros(size, dtype=np.int64)
        self.first = np.full(size, -1, dtype=np.int64)

    def insert(self, words: np.ndarray, counts: np.ndarray) -> None:
        """Adds rows numbered from 0; the table must have room for all of them."""
        waiting = np.arange(len(words))
        place = words[:, -1] & self.mask
        slot = np.empty(len(words), dtype=np.int64)
        while len(waiting):
            at = place[waiting].astype(np.int64)
            taken = self.used[at]
            same = taken & (self.rest[at] == words[waiting]).all(axis=1)
            slot[waiting[same]] = at[same]
            free = waiting[~taken]
            new_at, index = np.unique(at[~taken], return_index=True)
            winners = free[index]
            self.used[new_at] = True
            self.rest[new_at] = words[winners]
            self.first[new_at] = winners
            slot[winners] = new_at
            settled = same.copy()
            settled[np.flatnonzero(~taken)[index]] = True
            other = taken & ~same
            place[waiting[other]] = (place[waiting[other]] + np.uint64(1)) & self.mask
            waiting = waiting[~settled]
        np.add.at(self.count, slot, counts)


def _once(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first of each identifier, and how many deliveries each stands for."""
    table = QuotientTable(words.shape[1], len(words))
    table.insert(words, counts)
    rows = table.first[table.used]
    order = np.argsort(rows, kind="stable")
    return rows[order], table.count[table.used][order]


def once_per_id(
    df: DataFrame, id_column: str, order: Sequence[Column] = (), payload: bool = True, shard_rows: int | None = None
) -> DataFrame:
    """(request_id, n_deliveries[, kept struct of all columns of `df`]), one row per identifier.

    `order`: expressions, ascending, smallest first kept (nulls last; booleans and numbers, timestamps or strings).
    Give narrow expressions (the hash of a long text, not the text): they travel beside the row. Map side, every Arrow
    batch passes a table of its own first, so a hot identifier crosses the shuffle once a batch;
    shards are read one at a time in sorted order, so a task holds one shard however large its partition is.
    """
    spark = df.sparkSession
    rows = df.count()
    shard_rows = shard_rows or (WIDE_ROWS if payload else SHARD_ROWS)
    bits = max(0, math.ceil(math.log2(max(1, rows) / shard_rows))) if rows else 0
    keys = [f"o{i}" for i in range(len(order))]
    columns = [canonical_id(df[id_column]).alias("id"), *(c.alias(k) for c, k in zip(order, keys))]
    if payload:
        columns.append(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("kept"))
    slim = df.select(*columns).where(F.col("id").isNotNull())
    schema_in = slim.schema
    carried = [f for f in schema_in.fields if f.name != "id"]

    def ranked(table: pa.Table) -> pa.Table:
        return table.sort_by([(k, "ascending") for k in keys]) if keys else table

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = ranked(pa.Table.from_batches([batch]))
            for where, words in encode_ids(t["id"].to_pylist()):
                mixed = permute(words)
                first, n = _once(mixed, np.ones(len(mixed), dtype=np.int64))
                chosen = mixed[first]
                shard = (chosen[:, 0] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(first), dtype=np.int32)
                part = t.take(pa.array(where[first]))
                rest = [row.tobytes() for row in np.ascontiguousarray(chosen)]
                arrays = [pa.array(shard), pa.array(rest, pa.binary()), pa.array(n)]
                names = ["shard", "rest", "n"]
                out = pa.table(dict(zip(names, arrays)) | {c: part[c] for c in part.column_names})
                yield from out.combine_chunks().to_batches()

    def merge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = ranked(t)
        rest = t["rest"].to_pylist()
        n = t["n"].to_numpy()
        by_width: dict[int, list[int]] = {}
        for i, raw in enumerate(rest):
            by_width.setdefault(len(raw), []).append(i)
        for where in by_width.values():
            words = np.frombuffer(b"".join(rest[i] for i in where), dtype="<u8").reshape(len(where), -1)
            first, total = _once(words, n[where])
            part = t.take(pa.array(np.array(where)[first]))
            out = {"request_id": part["id"], "n_deliveries": pa.array(total)} | ({"kept": part["kept"]} if payload else {})
            yield from pa.table(out).combine_chunks().to_batches()

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, parts = None, []
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)]):
                if a == b:
                    continue
                if parts and shards[a] != open_shard:
                    yield from merge(pa.Table.from_batches(parts))
                    parts = []
                open_shard = shards[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from merge(pa.Table.from_batches(parts))

    ddl = {f.name: f.dataType.simpleString() for f in carried}
    middle = "shard int, rest binary, n long, id string" + "".join(f", {k}: {ddl[k]}" for k in keys)
    result = "request_id string, n_deliveries long"
    if payload:
        from pyspark.sql import types as T

        middle_type = T.StructType(
            [T.StructField("shard", T.IntegerType()), T.StructField("rest", T.BinaryType()), T.StructField("n", T.LongType()), *schema_in.fields]
        )
        result_type = T.StructType(
            [T.StructField("request_id", T.StringType()), T.StructField("n_deliveries", T.LongType()), schema_in["kept"]]
        )
    else:
        middle_type, result_type = middle, result
    # a shard is about 100 bytes a row, and the payload where there is one
    parts = partitions_for(spark, rows * (1000.0 if payload else 100.0))
    return (
        slim.mapInArrow(local, middle_type)
        .repartition(parts, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(by_shard, result_type)
    )
