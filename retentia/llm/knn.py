"""The k most similar vectors of every vector, by cosine.

Method: adaptive dimension scan. Unit vectors are turned into the principal axes of a sample, so that the first
columns hold most of a distance, and kept in column blocks. Every vector belongs to one list (nearest centroid) and
probes several; in a list, the distance over the first block is compared with a bound on what a vector within the
query's k-th best so far would show there, and candidates that fail this test are abandoned before the next block. The
bounds are quantiles measured on near pairs of the sample: a test wrongly rejects a neighbour once in `1 / LEVEL` times.

Scale. The number of lists grows with the square root of the rows, so centroids and sample stay small on the driver.
Lists are found in two steps, cells of lists first, so a vector is compared with some hundreds of centroids and not with
all of them. How many lists a query probes is measured, not set: the exact neighbours of PROBE_QUERIES vectors among all
rows are found by one plain pass, and the number of lists in which TARGET of them stand is taken. Lists are joined into
groups of bounded size by bisection, and a query travels once to each group that holds one of its lists, as 16-bit
fixed-point numbers (rounding moves a similarity by about 0.00002). A list or group beyond the bound is divided into
chunks, as are its queries, so no task holds an unbounded group. Equal vectors are compared once.

Only the centroids, the axes and the bounds come from the sample (SAMPLE_A_LIST rows a list, copies of a vector once);
every row is indexed and every row is a query.

Defined results: null keys, vectors that are null, of another length, all zero or not finite play no part; a key
in several rows counts once (its rows' vectors are all indexed, the best similarity stands); equal vectors (the same
after the rounding) are each other's nearest, in the order of their keys; fewer than k others give fewer rows; an empty
table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists are LISTS x the square root of the rows.
LISTS, SAMPLE_A_LIST = 0.75, 40
#: Queries whose exact neighbours decide how many lists are probed, the share of them that must be found, least lists.
PROBE_QUERIES, TARGET, LEAST_PROBES = 256, 0.97, 8
#: Cells that a vector looks for its lists in, and rows routed at once.
CELLS, ROUTE_ROWS = 16, 4096
#: What a coordinate of a unit vector is multiplied by to be a 16-bit number.
FIXED = 32767.0
#: Vectors that a task remembers as already sent; beyond it copies are sent again and dropped where they arrive.
SEEN = 1 << 20
#: Index rows and queries of one task at most, index rows at least, and the groups that even few rows are divided into.
GROUP_ROWS, QUERY_ROWS, LEAST_ROWS, GROUPS = 1 << 18, 1 << 18, 1 << 13, 4
#: What a routed copy of a vector is for.
INDEX, QUERY, BOTH = 0, 1, 2
#: Queries and list rows of one block of the scan.
QUERY_BATCH, LIST_COLUMNS = 1 << 12, 1 << 11
#: Share of near pairs that a test may reject, and the ends of the column blocks as shares of the dimensions.
LEVEL, BLOCKS = 0.002, (0.25, 0.5)


@dataclass
class Index:
    """What is fitted on the sample."""

    axes: np.ndarray
    centroids: np.ndarray
    group_of: np.ndarray
    index_chunks: np.ndarray
    query_chunks: np.ndarray
    ends: list[int]
    bounds: list[float]
    probes: int
    cells: np.ndarray
    lists_of: list[np.ndarray]

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, similarities) of the `probes` nearest lists of each row of `x`, nearest first, by way of its cells."""
        return nearest_lists(x, self.centroids, self.cells, self.lists_of, self.probes)

    def tasks(self) -> np.ndarray:
        """First task number of each group, and the number of tasks at the end."""
        return np.concatenate([[0], np.cumsum(self.index_chunks * self.query_chunks)]).astype(np.int64)


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the rows with `dim` finite values that are not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    top = np.abs(values).max(axis=1) if len(values) else np.empty(0)
    good = np.isfinite(top) & (top > 0)
    values = values[good] / top[good][:, None]
    return rows[good], (values / np.linalg.norm(values, axis=1)[:, None]).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        filled, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        keep = norms > 1e-6
        centroids[filled[keep]] = sums[keep] / norms[keep][:, None]
    return centroids


def _bisect(centroids: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """Group of each centroid: halves along the longest axis until a group is within `most` or one centroid."""
    group = np.zeros(len(centroids), dtype=np.int64)
    waiting, done = [np.arange(len(centroids))], 0
    while waiting:
        own = waiting.pop()
        if len(own) == 1 or weight[own].sum() <= most:
            group[own] = done
            done += 1
            continue
        x = centroids[own] - np.average(centroids[own], axis=0)
        axis = np.linalg.svd(x, full_matrices=False)[2][0]
        own = own[np.argsort(x @ axis, kind="stable")]
        half = np.cumsum(weight[own])
        cut = int(np.clip(np.searchsorted(half, half[-1] / 2) + 1, 1, len(own) - 1))
        waiting += [own[:cut], own[cut:]]
    return group


def nearest_lists(x: np.ndarray, centroids: np.ndarray, cells: np.ndarray, lists_of: list[np.ndarray], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest lists of each row, -1 where its cells hold fewer; a row looks into CELLS cells or as many as hold four
    times the lists that it needs."""
    longest = max(len(l) for l in lists_of)
    n_cells = len(cells)
    mean = len(centroids) / n_cells
    wanted = min(n_cells, max(CELLS, math.ceil(4 * probes / mean)))
    if wanted == n_cells:
        s = x @ centroids.T
        top = np.argpartition(-s, min(probes, s.shape[1]) - 1, axis=1)[:, :probes]
        best = np.take_along_axis(s, top, 1)
    else:
        reach = x @ cells.T
        own = np.argpartition(-reach, wanted - 1, axis=1)[:, :wanted]
        s = np.full((len(x), wanted * longest), -np.inf, dtype=np.float32)
        lists = np.full((len(x), wanted * longest), -1, dtype=np.int64)
        slot = np.full((len(x), n_cells), -1, dtype=np.int64)
        np.put_along_axis(slot, own, np.arange(wanted)[None, :], 1)
        for cell in range(n_cells):
            rows = np.flatnonzero(slot[:, cell] >= 0)
            if len(rows):
                at = slot[rows, cell][:, None] * longest + np.arange(len(lists_of[cell]))[None, :]
                s[rows[:, None], at] = x[rows] @ centroids[lists_of[cell]].T
                lists[rows[:, None], at] = lists_of[cell][None, :]
        top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
        best, top = np.take_along_axis(s, top, 1), np.take_along_axis(lists, top, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    return np.take_along_axis(top, order, 1), np.take_along_axis(best, order, 1)


def fit(sample: np.ndarray, rows: int, k: int) -> Index:
    """Axes, lists, cells and test bounds for `rows` vectors from a sample of them; groups and probes come later."""
    dim = sample.shape[1]
    axes = np.linalg.eigh(sample.T.astype(np.float64) @ sample)[1][:, ::-1].astype(np.float32)
    x = np.ascontiguousarray(sample @ axes)
    x = x[np.sort(np.unique(np.round(x * FIXED).astype(np.int16), axis=0, return_index=True)[1])]
    n_lists = int(max(1, min(len(x), round(LISTS * rows**0.5))))
    centroids = _kmeans(x, n_lists)
    # lists that hold nothing of the sample would be probed for nothing
    filled = np.unique(np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 4096))]))
    centroids = centroids[filled]
    cells = _kmeans(centroids, max(1, round(len(centroids) ** 0.5)))
    cell_of = (centroids @ cells.T).argmax(axis=1)
    used = np.unique(cell_of)
    cells, lists_of = cells[used], [np.flatnonzero(cell_of == c) for c in used]
    ends = sorted({max(1, int(dim * share)) for share in BLOCKS} - {dim})
    # near pairs of the sample: what share of a full distance shows in the first columns
    kth, ratios = min(k, max(1, len(x) - 1)), []
    few = x[:: max(1, len(x) // 1024)][:1024]
    for part in np.array_split(few, -(-len(few) // 128)):
        s = part @ x.T
        s[s > 1 - 1e-6] = -2
        best = np.argpartition(-s, kth - 1, axis=1)[:, :kth]
        squares = (x[best] - part[:, None, :]) ** 2
        full = np.maximum(squares.sum(axis=2), 1e-12)
        ratios.append(np.stack([squares[:, :, :end].sum(axis=2) / full for end in ends]).reshape(len(ends), -1))
    bounds = np.quantile(np.concatenate(ratios, axis=1), 1 - LEVEL, axis=1).tolist()
    nothing = np.zeros(0, dtype=np.int64)
    return Index(axes, centroids, nothing, nothing, nothing, ends, bounds, 1, cells, lists_of)


def arrange(index: Index, sample: np.ndarray, rows: int, probes: int, group_rows: int, query_rows: int) -> None:
    """Sets how many lists are probed and joins the lists into groups of bounded size, by the sample's share in each."""
    x = sample @ index.axes
    n_lists = len(index.centroids)
    index.probes = min(probes, n_lists)
    scale = rows / len(x)
    probed = np.concatenate([index.probed(part)[0] for part in np.array_split(x, -(-len(x) // ROUTE_ROWS))])
    weight = np.bincount(probed[:, 0], minlength=n_lists) * scale
    index.group_of = group_of = _bisect(index.centroids, weight, group_rows)
    n_groups = int(group_of.max()) + 1
    row, at = np.nonzero(probed >= 0)
    visited = np.unique(row * n_groups + group_of[probed[row, at]])
    visits = np.bincount(visited % n_groups, minlength=n_groups) * scale
    rows_of = np.bincount(group_of, weights=weight, minlength=n_groups)
    index.index_chunks = np.maximum(1, np.ceil(rows_of / (2 * group_rows))).astype(np.int64)
    index.query_chunks = np.maximum(1, np.ceil(visits / query_rows)).astype(np.int64)


def exact_neighbours(vectors: DataFrame, queries: np.ndarray, axes: np.ndarray, k: int, dim: int) -> DataFrame:
    """(q, sim, code): the k best of all rows for each of a few rotated unit queries, equal vectors once and left out
    where they are the query; every task gives at most k rows a query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims = np.full((len(queries), k), -np.inf, dtype=np.float32)
        held = np.zeros((len(queries), k, dim), dtype=np.int16)
        for batch in batches:
            _, unit = unit_rows(batch.column("vector"), dim)
            for part in np.array_split(unit, max(1, -(-len(unit) // ROUTE_ROWS))):
                if not len(part):
                    continue
                codes = _fixed(part @ axes)
                s = queries @ (codes.astype(np.float32) / FIXED).T
                s[s > 1 - 1e-6] = -np.inf
                top = np.argpartition(-s, min(4 * k, s.shape[1]) - 1, axis=1)[:, : 4 * k]
                for i in range(len(queries)):
                    own = top[i][s[i, top[i]] > sims[i, -1]]
                    if not len(own):
                        continue
                    value, code = np.concatenate([sims[i], s[i, own]]), np.concatenate([held[i], codes[own]])
                    fresh = np.sort(np.unique(np.column_stack([code, np.isfinite(value)]), axis=0, return_index=True)[1])
                    fresh = fresh[np.argsort(-value[fresh], kind="stable")][:k]
                    sims[i, : len(fresh)], held[i, : len(fresh)] = value[fresh], code[fresh]
        at, nth = np.nonzero(np.isfinite(sims))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sims[at, nth]), pa.array([c.tobytes() for c in held[at, nth]], pa.binary())], ["q", "sim", "code"])

    found = vectors.mapInArrow(scan, "q int, sim float, code binary").distinct()
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "code"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "sim", "code")


def measured_probes(vectors: DataFrame, index: Index, sample: np.ndarray, k: int, dim: int) -> int:
    """The number of lists in which TARGET of the exact neighbours of some sample rows stand."""
    step = max(1, len(sample) // PROBE_QUERIES)
    queries = _fixed(sample[::step][:PROBE_QUERIES] @ index.axes).astype(np.float32) / FIXED
    near = exact_neighbours(vectors, queries, index.axes, k, dim).toArrow()
    n_lists = len(index.centroids)
    if not near.num_rows:
        return min(LEAST_PROBES, n_lists)
    x = np.frombuffer(b"".join(near["code"].to_pylist()), dtype=np.int16).reshape(-1, dim).astype(np.float32) / FIXED
    home = nearest_lists(x, index.centroids, index.cells, index.lists_of, 1)[0][:, 0]
    s = queries @ index.centroids.T
    q = near["q"].to_numpy()
    # lists nearer to the query than the one that holds its neighbour
    nearer = (s[q] > s[q, home][:, None]).sum(axis=1) + 1
    return int(min(n_lists, max(LEAST_PROBES, np.quantile(nearer, TARGET, method="higher"))))


def _keep_best(sims: np.ndarray, ids: np.ndarray, row: np.ndarray, sim: np.ndarray, found: np.ndarray) -> None:
    """Puts candidates (row, sim, id) into the best lists in place."""
    k = sims.shape[1]
    if not len(row):
        return
    order = np.lexsort((-sim, row))
    row, sim, found = row[order], sim[order], found[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = nth < k
    row, sim, found, nth = row[keep], sim[keep], found[keep], nth[keep]
    touched, at = np.unique(row, return_inverse=True)
    new_s = np.full((len(touched), 2 * k), -np.inf, dtype=np.float32)
    new_i = np.full((len(touched), 2 * k), -1, dtype=np.int64)
    new_s[:, :k], new_i[:, :k] = sims[touched], ids[touched]
    new_s[at, k + nth], new_i[at, k + nth] = sim, found
    best = np.argsort(-new_s, axis=1, kind="stable")[:, :k]
    sims[touched], ids[touched] = np.take_along_axis(new_s, best, 1), np.take_along_axis(new_i, best, 1)


def scan_list(q: np.ndarray, qn: np.ndarray, x: np.ndarray, xn: np.ndarray, bar: np.ndarray, ends: list[int], bounds: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, list row, similarity) of the pairs above each query's `bar` that no test abandoned.

    qn, xn: squared norms over the columns before each end, one row per end.
    """
    start, dots, rows, cols = 0, None, None, None
    left = 2 - 2 * np.maximum(bar, -1.0)
    for step, (end, bound) in enumerate(zip(ends, bounds)):
        if rows is None:
            part = q[:, start:end] @ x[:, start:end].T
            dots = part if dots is None else dots + part
            passed = dots >= ((qn[step] - bound * left) / 2)[:, None] + xn[step][None, :] / 2
            alive = np.count_nonzero(passed)
            if alive * 8 < passed.size:
                rows, cols = np.nonzero(passed)
                dots = dots[rows, cols]
        else:
            dots = dots + np.einsum("ij,ij->i", q[rows, start:end], x[cols, start:end])
            keep = dots >= (qn[step][rows] - bound * left[rows] + xn[step][cols]) / 2
            rows, cols, dots = rows[keep], cols[keep], dots[keep]
        start = end
    if rows is None:
        part = q[:, start:] @ x[:, start:].T
        dots = part if dots is None else dots + part
        rows, cols = np.nonzero(dots > bar[:, None])
        return rows, cols, dots[rows, cols]
    dots = dots + np.einsum("ij,ij->i", q[rows, start:], x[cols, start:])
    keep = dots > bar[rows]
    return rows[keep], cols[keep], dots[keep]


def _best_of_list(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, list row, similarity) of the k best of a list for each query, compared in full."""
    k = min(k, len(x))
    dots = q @ x.T
    cols = np.argpartition(dots, len(x) - k, axis=1)[:, len(x) - k :]
    rows = np.repeat(np.arange(len(q)), k)
    cols = cols.ravel()
    return rows, cols, dots[rows, cols]


def search_group(index: Index, group: int, x: np.ndarray, x_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, ids) of the k best in one group for each query, over the lists that it probes."""
    own = np.flatnonzero(index.group_of == group)
    centroids = index.centroids[own]
    near = (x @ centroids.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    x, x_ids, near = x[order], x_ids[order], near[order]
    at = np.searchsorted(near, np.arange(len(own) + 1))
    norms = lambda m: [np.square(m[:, :end]).sum(axis=1) for end in index.ends]
    xn = norms(x)
    all_s, all_i = [], []
    for lo in range(0, len(q), QUERY_BATCH):
        part, ids = q[lo : lo + QUERY_BATCH], q_ids[lo : lo + QUERY_BATCH]
        reach = part @ centroids.T
        probed = reach >= (q_bar[lo : lo + QUERY_BATCH] - 1e-5)[:, None]
        first = reach.argmax(axis=1)
        probed[np.arange(len(part)), first] = True
        sims = np.full((len(part), k), -np.inf, dtype=np.float32)
        best = np.full((len(part), k), -1, dtype=np.int64)
        qn = norms(part)
        for turn in (0, 1):
            for l in range(len(own)):
                a, b = at[l], at[l + 1]
                who = np.flatnonzero((first == l) if not turn else probed[:, l] & (first != l))
                if a == b or not len(who):
                    continue
                for c in range(a, b, LIST_COLUMNS):
                    d = min(b, c + LIST_COLUMNS)
                    if not turn and c == a:
                        rows, cols, dots = _best_of_list(part[who], x[c:d], k + 1)
                    else:
                        rows, cols, dots = scan_list(part[who], [n[who] for n in qn], x[c:d], [n[c:d] for n in xn], sims[who, k - 1], index.ends, index.bounds)
                    other = x_ids[c + cols] != ids[who[rows]]
                    _keep_best(sims, best, who[rows[other]], dots[other], x_ids[c + cols[other]])
        all_s.append(sims)
        all_i.append(best)
    return np.concatenate(all_s), np.concatenate(all_i)


def _spark_hash(value: int, seed: int = 42) -> int:
    """Spark's hash of one int column."""
    m = 0xFFFFFFFF
    rotate = lambda v, r: ((v << r) | (v >> (32 - r))) & m
    k = rotate((value & m) * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = (rotate(seed ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def partition_names(n: int) -> np.ndarray:
    """An int for each of `n` partitions that hash partitioning puts there, so that every task has one to itself."""
    names, value, missing = np.full(n, -1, dtype=np.int32), 0, n
    while missing:
        at = _spark_hash(value) % n
        if names[at] < 0:
            names[at] = value
            missing -= 1
        value += 1
    return names


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * FIXED).clip(-FIXED, FIXED).astype(np.int16)


def _codes(vectors: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit rotated vectors, 64-bit ids that equal vectors share).

    The product is taken in double precision, so the rounding is the same in whatever batch a vector comes.
    """
    codes = _fixed(vectors.astype(np.float64) @ axes.astype(np.float64))
    words = np.ascontiguousarray(codes).view(np.uint8)
    padded = np.zeros((len(codes), -(-words.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : words.shape[1]] = words
    total = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, word in enumerate(padded.view(np.uint64).T):
            total = _mix(total + word + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
    return codes, total.view(np.int64)


def nearest_representatives(vectors: DataFrame, index: Index, k: int, dim: int, min_similarity: float | None = None) -> DataFrame:
    """(rep, near array<struct<sim, rep>>): the k best other vectors of each different vector, best first.

    Every group is searched for the k best; of these, those under `min_similarity` stay out of the merge, which cannot
    change the k best at or above it.
    """
    first_task = index.tasks()
    names = partition_names(int(first_task[-1]))
    task_of = {int(name): task for task, name in enumerate(names)}
    n_groups = int(index.group_of.max()) + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            _, unit = unit_rows(batch.column("vector"), dim)
            if not len(unit):
                continue
            codes, reps = _codes(unit, index.axes)
            fresh = np.zeros(len(reps), dtype=bool)
            for i, rep in enumerate(reps.tolist()):
                fresh[i] = rep not in seen
                seen.add(rep)
            if len(seen) > SEEN:
                seen.clear()
            codes, reps = codes[fresh], reps[fresh]
            if not len(reps):
                continue
            parts = [index.probed(part.astype(np.float32) / FIXED) for part in np.array_split(codes, -(-len(codes) // ROUTE_ROWS))]
            lists, reach = (np.concatenate(p) for p in zip(*parts))
            home = index.group_of[lists[:, 0]]
            bar = np.where(np.isfinite(reach), reach, np.inf).min(axis=1)
            salt = _mix(reps.view(np.uint64))
            at, nth = np.nonzero(lists >= 0)
            visited = np.unique(at * n_groups + index.group_of[lists[at, nth]])
            rows, groups = visited // n_groups, visited % n_groups
            everyone = np.arange(len(reps))
            # an index row goes to its chunk for every chunk of queries, a query to every chunk of the index
            task, row, other, _ = _spread(first_task, home, salt, index.index_chunks, index.query_chunks, everyone, True)
            as_query = other == (salt[row] % index.query_chunks[home[row]].astype(np.uint64)).astype(np.int64)
            copies = [(task, row, np.where(as_query, BOTH, INDEX))]
            task, at, other, _ = _spread(first_task, groups, salt[rows], index.query_chunks, index.index_chunks, np.arange(len(rows)), False)
            row = rows[at]
            there = (groups[at] == home[row]) & (other == (salt[row] % index.index_chunks[home[row]].astype(np.uint64)).astype(np.int64))
            copies.append((task[~there], row[~there], np.full((~there).sum(), QUERY)))
            for task, row, role in copies:
                data = np.zeros((len(row), 2 * dim + 5), dtype=np.uint8)
                data[:, : 2 * dim] = codes[row].view(np.uint8)
                data[:, 2 * dim : 2 * dim + 4] = bar[row].astype("<f4")[:, None].view(np.uint8)
                data[:, -1] = role
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[task]), pa.array(reps[row]), pa.Array.from_buffers(pa.binary(data.shape[1]), len(row), [None, pa.py_buffer(data)]).cast(pa.binary())],
                    ["slot", "rep", "code"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            tasks = batch.column("slot").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and tasks[a] != task:
                    yield from searched(task, held)
                    held = []
                task = tasks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from searched(task, held)

    def searched(task: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        group = int(np.searchsorted(first_task, task_of[task], side="right")) - 1
        reps = t["rep"].to_numpy()
        data = np.concatenate([_bytes_of(chunk, 2 * dim + 5) for chunk in t["code"].chunks])
        role = data[:, -1]
        bar = np.ascontiguousarray(data[:, 2 * dim : 2 * dim + 4]).view("<f4").ravel()
        codes = np.ascontiguousarray(data[:, : 2 * dim]).view(np.int16)

        def chosen(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero((role == kind) | (role == BOTH))
            at = at[np.unique(reps[at], return_index=True)[1]]
            x = codes[at].astype(np.float32)
            return x / np.linalg.norm(x, axis=1)[:, None], reps[at], bar[at]

        x, x_ids, _ = chosen(INDEX)
        q, q_ids, q_bar = chosen(QUERY)
        if not len(x) or not len(q):
            return
        for lo in range(0, len(q), 4 * QUERY_BATCH):
            part = slice(lo, lo + 4 * QUERY_BATCH)
            sims, ids = search_group(index, group, x, x_ids, q[part], q_ids[part], q_bar[part], k)
            full = np.isfinite(sims) if min_similarity is None else sims >= np.float32(min_similarity)
            n = full.sum(axis=1)
            some = n > 0
            full, n, sims, ids = full[some], n[some], sims[some], ids[some]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(sims[full]), pa.array(ids[full])], ["sim", "rep"])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[part][some]), pa.ListArray.from_arrays(offsets, pairs)], ["rep", "near"])

    routed = vectors.mapInArrow(route, "slot int, rep long, code binary")
    found = routed.repartition(len(names), "slot").sortWithinPartitions("slot").mapInArrow(search, "rep long, near array<struct<sim: float, rep: long>>")
    merged = found.groupBy("rep").agg(F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("rep", F.slice(F.sort_array("near", asc=False), 1, k).alias("near"))


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of one width as rows of bytes, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _spread(
    first_task: np.ndarray, group: np.ndarray, salt: np.ndarray, own: np.ndarray, others: np.ndarray, row: np.ndarray, index_side: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(task, row, chunk of the other side, own chunk) copies: one per chunk of the other side."""
    mine = (salt % own[group].astype(np.uint64)).astype(np.int64)
    n = others[group]
    copy = np.repeat(np.arange(len(row)), n)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
    g, mine = group[copy], mine[copy]
    task = first_task[g] + (mine * others[g] + other if index_side else other * own[g] + mine)
    return task, row[copy], other, mine


def nearest(
    df: DataFrame,
    key: Column,
    vector: Column,
    k: int = 5,
    dim: int = 64,
    probes: int | None = None,
    min_similarity: float | None = None,
    group_rows: int | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(key, neighbour, similarity, place): the k most similar other keys of every key, best first.

    `min_similarity` drops neighbours below it after the k best are known; `probes` sets the lists that a query looks
    into, which are measured otherwise.
    """
    spark = df.sparkSession
    slim = df.select(key.cast("string").alias("key"), vector.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    slim = slim.where(F.col("key").isNotNull() & (F.size("vector") == dim) & finite & F.exists("vector", lambda v: v != 0))
    rows = slim.count()
    result = "key string, neighbour string, similarity float, place int"
    if not rows:
        return spark.createDataFrame([], result)
    wanted = SAMPLE_A_LIST * max(1, round(LISTS * rows**0.5))
    share = min(1.0, max(wanted, 2048) / rows)
    drawn = (slim.sample(share, 17) if share < 1 else slim).select("vector").toArrow()
    sample = unit_rows(drawn["vector"], dim)[1]
    if not len(sample):  # a draw of none of the few rows there are
        sample = unit_rows(slim.select("vector").limit(2048).toArrow()["vector"], dim)[1]
    index = fit(sample, rows, k)
    if group_rows is None:
        group_rows = min(GROUP_ROWS, max(LEAST_ROWS, rows * 11 // (10 * GROUPS)))  # halves are seldom quite even
    arrange(index, sample, rows, measured_probes(slim.select("vector"), index, sample, k, dim) if probes is None else probes, group_rows, query_rows)
    axes = index.axes

    def belong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = unit_rows(batch.column("vector"), dim)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(_codes(unit, axes)[1]), batch.column("key").take(pa.array(at))], ["rep", "key"])

    members = slim.mapInArrow(belong, "rep long, key string").distinct()
    near = nearest_representatives(slim.select("vector"), index, k, dim, min_similarity)
    near = near.select(F.col("rep").alias("of"), F.posexplode("near").alias("pos", "n")).select("of", "pos", F.col("n.rep").alias("rep"), F.col("n.sim").alias("sim"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("key"))
    few = members.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    own = few.groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("own"))
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("sim"), "pos", "key"))
    others = near.join(few.where(F.col("nth") <= k), "rep").withColumn("place", place).where(F.col("place") <= k)
    others = others.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("place", F.col("sim").alias("similarity"), F.col("key").alias("neighbour")))).alias("others"))
    others = others.select(F.col("of").alias("rep"), F.transform("others", lambda o: F.struct(o["similarity"].alias("similarity"), o["neighbour"].alias("neighbour"))).alias("others"))
    same = F.transform(
        F.filter("own", lambda o: o != F.col("key")), lambda o: F.struct(F.lit(1.0).cast("float").alias("similarity"), o.alias("neighbour"))
    )
    each = members.join(own, "rep").join(others, "rep", "left")
    each = each.select("key", F.slice(F.concat(same, F.coalesce("others", F.expr("array()").cast(others.schema["others"].dataType))), 1, k).alias("best"))
    each = each.select("key", F.posexplode("best").alias("place", "b")).select("key", F.col("b.neighbour").alias("neighbour"), F.col("b.similarity").alias("similarity"), F.col("place").cast("int").alias("place"))
    return each.where(F.col("neighbour") != F.col("key"))
