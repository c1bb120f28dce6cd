"""Records whose texts hold nearly the same words.

The similarity of two texts is the number of words they share, counted with repetition, over the word count of the
longer one. All pairs at `threshold` or more are found, without loss, in four steps:

1. Every text is hashed once: its words become a sorted array of 64-bit hashes, the repetitions of a word told apart,
   and texts with the same words one class, named by 128 bits. This table is written to the shared folder and all later
   steps read the columns they need of it. Rare words come first; rarity is read from a count sketch of fixed size over
   all texts, so the order is global whatever the vocabulary.
2. Two classes at the threshold share one of their first n - ceil(threshold n) + 1 words (prefix filter), and what is
   left of the shorter one from the first such word on must still hold the overlap (positional filter), so only classes
   under one such word are compared. A word in the prefixes of very many classes is split into chunks that are compared
   pairwise in separate tasks.
3. Bit-sliced comparison: each class has a parity signature of its words, two bits or more a word, whose width doubles
   with the length class; a class meets a shorter length class with its signature folded. The signatures of a run of
   classes are stored as vertical bit planes, and the distances of 64 neighbours at a time are counted by carry-save
   adders over the planes. The Hamming distance never exceeds the number of words not shared, so a lane whose count
   exceeds its own radius is no case; a word of lanes is abandoned once all of them exceed it.
4. What is left is compared exactly.

Defined results: null texts and texts without words are no case; a key may hold several texts, any of which counts;
repeated rows count once; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.session import checkpointed, partitions_for, stored

#: Rows of the count sketch, the least and most bits of its width (12 MB at most), and cells in one shuffled stripe.
SKETCH_ROWS, SKETCH_BITS, STRIPE = 3, (12, 20), 4096
#: Planes of the signatures of texts of up to half as many words, and planes counted between two looks at the radius.
PLANES, PLANES_A_STEP = 128, 32
#: Classes that a task remembers as already given; beyond it they are given again and dropped where they arrive.
SEEN = 1 << 20
#: Keys of one class that are paired in one task.
CHUNK_KEYS = 2048
#: Classes under one prefix word that are compared in one task.
CHUNK = 4096

_WORD = re.compile(rb"[a-z0-9]+")
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text); the n-th repetition of a word in a text has a hash of its own."""
    import xxhash

    cache: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    flat: list[int] = []
    sizes = np.empty(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = _WORD.findall(text.lower().encode("utf-8", "surrogatepass"))
        sizes[k] = len(words)
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = digest(w)
            flat.append(h)
    hashes = np.array(flat, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    nth = (np.arange(len(h)) - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(nth == 0, h, _mix(h + nth * _ODD)), sizes


def overlap_needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """Smallest whole overlap that is `threshold` of `n` or more."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


def length_class(n: np.ndarray) -> np.ndarray:
    """0 for texts of up to PLANES / 2 words, 1 for up to twice as many, and so on."""
    return np.ceil(np.log2(np.maximum(n, 1) / (PLANES // 2))).clip(0).astype(np.int64)


def signatures(hashes: np.ndarray, sizes: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """Parity signatures as rows of planes / 8 bytes: bit j is the parity of the words that hash to it."""
    at = (_mix(hashes ^ _ODD) & np.uint64(planes - 1)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    step = max(1, (1 << 22) // planes)
    out = np.empty((len(sizes), planes // 8), dtype=np.uint8)
    for a in range(0, len(sizes), step):
        own = sizes[a : a + step]
        bits = np.bincount(np.repeat(np.arange(len(own)), own) * planes + at[starts[a] : starts[a] + own.sum()], minlength=len(own) * planes)
        out[a : a + step] = np.packbits((bits & 1).astype(np.uint8).reshape(len(own), planes), axis=1, bitorder="little")
    return out


def folded(rows: np.ndarray) -> np.ndarray:
    """Signatures of half the width: the parity of both halves."""
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def class_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit ids, rows of two words, of each text's multiset of words (order plays no part); `sizes` must be positive."""
    starts = np.cumsum(sizes) - sizes
    n = sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        one, two = np.add.reduceat(_mix(hashes + _ODD), starts), np.add.reduceat(_mix(_mix(hashes ^ _OTHER)), starts)
        return np.stack([_mix(one + n), _mix(two ^ (n * _ODD))], axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes one after another, words of each row) of a column of word arrays."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype="<u8", count=(offsets[-1] - offsets[0]) // 8, offset=offsets[0]) if data is not None and len(column) else np.empty(0, dtype=np.uint64)
    return flat, np.diff(offsets).astype(np.int64) // 8


class CountSketch:
    """How often a word occurs in all texts, estimated from above but for the load common to all cells.

    Three rows of cells, each with its own bits of the hash; the median load of a row is taken off its cells and the
    least of the three stands. Its width follows the number of texts up to a fixed bound.
    """

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits = bits
        cells = cells.reshape(SKETCH_ROWS, 1 << bits)
        self.cells = np.maximum(cells - np.median(cells, axis=1).astype(cells.dtype)[:, None], 0)

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [((hashes >> np.uint64(21 * row)) & np.uint64((1 << bits) - 1)).astype(np.int64) for row in range(SKETCH_ROWS)]

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        a, b, c = (row[place] for row, place in zip(self.cells, self.places(hashes, self.bits)))
        return np.minimum(np.minimum(a, b), c)

    @classmethod
    def of(cls, bodies: DataFrame, rows: int, pick: Callable = lambda hashes, sizes: hashes) -> CountSketch:
        """Counts of what `pick` takes of the words of each batch of `bodies` (words)."""
        low, high = SKETCH_BITS
        bits = min(high, max(low, rows.bit_length() - 2))
        n_stripes = (SKETCH_ROWS << bits) // STRIPE

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((SKETCH_ROWS, 1 << bits), dtype=np.int64)
            for batch in batches:
                hashes = pick(*_words_of(batch.column("words")))
                for row, place in zip(total, cls.places(hashes, bits)):
                    row += np.bincount(place, minlength=1 << bits)
            stripes = total.reshape(n_stripes, STRIPE).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(range(n_stripes), pa.int32()), pa.array([x.tobytes() for x in stripes], pa.binary())], ["stripe", "cells"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for stripe, cells in zip(batch.column("stripe").to_pylist(), batch.column("cells").to_pylist()):
                    total[stripe] = total.get(stripe, 0) + np.frombuffer(cells, dtype="<i8")
            if total:
                data = [x.astype("<i8").tobytes() for x in total.values()]
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(data, pa.binary())], ["stripe", "cells"])

        kind = "stripe int, cells binary"
        found = bodies.select("words").mapInArrow(count, kind).repartition("stripe").mapInArrow(add, kind).collect()
        cells = np.zeros((n_stripes, STRIPE), dtype=np.int64)
        for row in found:
            cells[row["stripe"]] = np.frombuffer(row["cells"], dtype="<i8")
        return cls(bits, cells)


def rare_first(hashes: np.ndarray, sizes: np.ndarray, sketch: CountSketch) -> np.ndarray:
    """The hashes with those of each text in order of rarity; equals in order of the hash."""
    return hashes[np.lexsort((hashes, sketch.estimate(hashes), np.repeat(np.arange(len(sizes)), sizes)))]


def prefixes(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every word in the prefix of its text."""
    length = sizes - overlap_needed(sizes, threshold) + 1
    owner = np.repeat(np.arange(len(sizes)), length)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)


def statements(texts: DataFrame) -> DataFrame:
    """(kind, key, class_id, words) of the texts with words, written to the shared folder; a task gives the words of a
    class with its first text and leaves them out afterwards."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for batch in batches:
            hashes, sizes = hashed_words(batch.column("text").to_pylist())
            rows = np.flatnonzero(sizes)
            if not len(rows):
                continue
            n = sizes[rows]
            ids = class_ids(hashes, n)
            ends = (np.cumsum(n) * 8).tolist()
            data = hashes.astype("<u8").tobytes()
            names = _binary(ids)
            bodies: list[bytes | None] = []
            kinds = batch.column("kind").take(pa.array(rows))
            for a, b, name in zip([0, *ends], ends, zip(kinds.to_pylist(), names.to_pylist())):
                bodies.append(None if name in seen else data[a:b])
                seen.add(name)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([kinds, batch.column("key").take(pa.array(rows)), names, pa.array(bodies, pa.binary())], ["kind", "key", "class_id", "words"])

    return stored(texts.mapInArrow(hashed, "kind string, key string, class_id binary, words binary"))


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """(planes, words) of 64 lanes each from signatures of 16 bytes; lanes are padded to whole words."""
    n = len(rows)
    padded = np.zeros((-(-n // 64) * 64, rows.shape[1]), dtype=np.uint8)
    padded[:n] = rows
    bits = np.unpackbits(padded, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _within(differ: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Lanes (as a bool array) whose count of set planes in `differ` is at most their radius; -1 rules a lane out.

    `differ`: (planes, words). Carry-save adders take the planes eight at a time into vertical counters.
    """
    n_words = differ.shape[1]
    n_bits = len(differ).bit_length()
    lanes = np.full(n_words * 64, -1, dtype=np.int64)
    lanes[: len(radius)] = radius
    limit = [np.packbits(((np.maximum(lanes, 0) >> b) & 1).astype(np.uint8), bitorder="little").view("<u8") for b in range(n_bits)]
    alive = np.packbits((lanes >= 0).astype(np.uint8), bitorder="little").view("<u8")
    where = np.flatnonzero(alive)
    counters = [np.zeros(len(where), dtype=np.uint64) for _ in range(n_bits)]
    for start in range(0, len(differ), PLANES_A_STEP):
        block = differ[start : start + PLANES_A_STEP][:, where]
        for k in range(0, len(block), 8):
            _add_eight(counters, block[k : k + 8])
        more, equal = np.zeros(len(where), dtype=np.uint64), np.full(len(where), ~np.uint64(0))
        for b in range(n_bits - 1, -1, -1):
            bound = limit[b][where]
            more |= equal & counters[b] & ~bound
            equal &= ~(counters[b] ^ bound)
        alive[where] &= ~more
        stay = alive[where] != 0
        if not stay.all():
            where = where[stay]
            counters = [c[stay] for c in counters]
        if not len(where):
            break
    return np.unpackbits(alive.view(np.uint8), bitorder="little").astype(bool)[: len(radius)]


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _add_eight(counters: list[np.ndarray], p: np.ndarray) -> None:
    ones, t1 = _csa(counters[0], p[0], p[1])
    ones, t2 = _csa(ones, p[2], p[3])
    ones, t3 = _csa(ones, p[4], p[5])
    ones, t4 = _csa(ones, p[6], p[7])
    twos, f1 = _csa(counters[1], t1, t2)
    twos, f2 = _csa(twos, t3, t4)
    fours, carry = _csa(counters[2], f1, f2)
    counters[0], counters[1], counters[2] = ones, twos, fours
    for b in range(3, len(counters)):
        counters[b], carry = counters[b] ^ carry, counters[b] & carry


#: Added to the side of a class that meets a shorter length class.
VISITOR = 4


def close_pairs(
    group: np.ndarray, side: np.ndarray, size: np.ndarray, rest: np.ndarray, ids: np.ndarray, rows: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of rows of one group whose signatures are within their pair's radius.

    Rows come sorted by group and, inside it, by size. `side`: 0 is compared with 1 only, 2 with every 2; with VISITOR
    added, not with other visitors. `rest`: words from the group's word on.
    """
    n = len(group)
    planes = bit_planes(rows)
    ends = np.searchsorted(group, group, side="right")
    reach = np.searchsorted(np.arange(n), ends) - 1 - np.arange(n)
    needed = overlap_needed(size, threshold)
    visits, side = side >= VISITOR, side % VISITOR
    left, right = [], []
    lane = np.arange(n)
    step, active = 1, lane[reach >= 1]
    while len(active):
        other = active + step
        radius = size[active] + size[other] - 2 * needed[other]
        ok = (size[active] >= needed[other]) & (ids[active] != ids[other])
        ok &= (side[active] == 2) | (side[active] != side[other])
        ok &= ~(visits[active] & visits[other]) & (np.minimum(rest[active], rest[other]) >= needed[other])
        full = np.full(n, -1, dtype=np.int64)
        full[active[ok]] = np.minimum(radius[ok], len(planes))
        words = np.unique(active[ok] >> 6)
        if len(words):
            moved = _moved_words(planes, words, step)
            lanes = (words[:, None] * 64 + np.arange(64)).ravel()
            inside = lanes < n
            r = np.full(len(lanes), -1, dtype=np.int64)
            r[inside] = full[lanes[inside]]
            close = lanes[_within(planes[:, words] ^ moved, r)]
            left.append(close)
            right.append(close + step)
        step += 1
        # sizes rise within a group, so a lane is done once the other side is too long for it
        active = active[(reach[active] >= step) & (size[active] >= needed[np.minimum(active + step - 1, n - 1)])]
    if not left:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def _moved_words(planes: np.ndarray, words: np.ndarray, by: int) -> np.ndarray:
    """The named words of the planes moved by `by` lanes."""
    whole, bits = divmod(by, 64)
    last = planes.shape[1] - 1
    low = planes[:, np.minimum(words + whole, last)] * (words + whole <= last)
    if not bits:
        return low
    high = planes[:, np.minimum(words + whole + 1, last)] * (words + whole + 1 <= last)
    return (low >> np.uint64(bits)) | (high << np.uint64(64 - bits))


def class_pairs(texts: DataFrame, threshold: float = 0.8, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of `texts` (kind, key, text).

    members: (kind, class_id, key), each key under the classes of its texts; pairs: (kind, a, b, shared, longer) of
    different classes at the threshold, a < b, each once.
    """
    spark = texts.sparkSession
    hashed = statements(texts.select("kind", "key", "text").where("text IS NOT NULL AND key IS NOT NULL"))
    bodies = hashed.where("words IS NOT NULL")
    n_bodies, n_words = bodies.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0)) / 8).first()
    sketch = CountSketch.of(bodies, n_bodies)

    def prefix_words(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        owner, place = prefixes(sizes, threshold)
        return rare_first(hashes, sizes, sketch)[(np.cumsum(sizes) - sizes)[owner] + place]

    heads = CountSketch.of(bodies, n_bodies, prefix_words)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = _words_of(batch.column("words"))
            if not len(sizes):
                continue
            starts = np.cumsum(sizes) - sizes
            owner, place = prefixes(sizes, threshold)
            token = rare_first(hashes, sizes, sketch)[starts[owner] + place]
            ids = np.frombuffer(b"".join(batch.column("class_id").to_pylist()), dtype="<u8").reshape(-1, 2)
            n_chunks = np.maximum(1, -(-heads.estimate(token) // chunk))
            own = (_mix(ids[:, 0] ^ _ODD)[owner] % n_chunks.astype(np.uint64)).astype(np.int64)
            copies = np.repeat(np.arange(len(owner)), n_chunks)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
            mine = own[copies]
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            side = np.where(low == high, 2, np.where(mine == low, 0, 1))
            with np.errstate(over="ignore"):
                block = token[copies] + _mix((low * n_chunks[copies] + high).astype(np.uint64)) * (n_chunks[copies] > 1)
            row, rest = owner[copies], (sizes[owner] - place)[copies]
            own_class, needed = length_class(sizes), overlap_needed(sizes, threshold)
            for c in np.unique(own_class).tolist():
                members = np.flatnonzero(own_class == c)
                flat = np.repeat(starts[members], sizes[members]) + np.arange(sizes[members].sum()) - np.repeat(np.cumsum(sizes[members]) - sizes[members], sizes[members])
                sign = signatures(hashes[flat], sizes[members], PLANES << c)
                at = np.full(len(sizes), -1, dtype=np.int64)
                at[members] = np.arange(len(members))
                for meets in range(c, -1, -1):
                    if meets < c:
                        sign = folded(sign)
                        at[needed > (PLANES // 2) << meets] = -1
                    chosen = np.flatnonzero(at[row] >= 0)
                    if not len(chosen):
                        break
                    r = row[chosen]
                    with np.errstate(over="ignore"):
                        where = _mix(block[chosen] + np.uint64(meets) * _OTHER)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("kind").take(pa.array(r)), pa.array(where.view(np.int64)), pa.array((side[chosen] + (VISITOR if meets < c else 0)).astype(np.int8)),
                            pa.array(sizes[r].astype(np.int32)), pa.array(rest[chosen].astype(np.int32)), batch.column("class_id").take(pa.array(r)), _binary(sign[at[r]]),
                        ],
                        ["kind", "block", "side", "n", "rest", "class_id", "sign"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * chunk:
                continue
            t = pa.Table.from_batches(held)
            block = t["block"].to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield from compared(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
            rows = 0
        if held:
            yield from compared(pa.Table.from_batches(held))

    def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        one = lambda c: t[c].chunk(0)
        codes = one("kind").dictionary_encode()
        kind, names = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary.to_pylist()
        coded = one("class_id").dictionary_encode()
        # numbers in the order of the ids
        values = np.frombuffer(b"".join(coded.dictionary.to_pylist()), dtype=">u8").reshape(-1, 2)
        order = np.lexsort((values[:, 1], values[:, 0]))
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        known = coded.dictionary.take(pa.array(order))
        all_ids = number[coded.indices.to_numpy(zero_copy_only=False)]
        widths = np.diff(np.frombuffer(one("sign").buffers()[1], dtype=np.int32)[one("sign").offset : one("sign").offset + t.num_rows + 1])
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            block, size, rest = (t[c].to_numpy()[own].astype(np.int64) for c in ("block", "n", "rest"))
            ids, side, k = all_ids[own], t["side"].to_numpy()[own].astype(np.int64), kind[own]
            order = np.lexsort((ids, size, k, block))
            k, block, size, rest, ids, side, own = k[order], block[order], size[order], rest[order], ids[order], side[order], own[order]
            new = np.concatenate([[True], (block[1:] != block[:-1]) | (k[1:] != k[:-1])])
            fresh = new.copy()
            fresh[1:] |= (ids[1:] != ids[:-1]) | (side[1:] != side[:-1])
            group = np.cumsum(new)
            members_of = np.bincount(group[fresh])
            keep = np.flatnonzero(fresh & (members_of[group] > 1))
            if not len(keep):
                continue
            sign = np.frombuffer(b"".join(one("sign").take(pa.array(own[keep])).to_pylist()), dtype=np.uint8).reshape(-1, width)
            i, j = close_pairs(group[keep], side[keep], size[keep], rest[keep], ids[keep], sign, threshold)
            a, b = ids[keep[i]], ids[keep[j]]
            pairs = np.unique(np.stack([k[keep[i]], np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[x] for x in pairs[:, 0].tolist()], pa.string()), known.take(pa.array(pairs[:, 1])), known.take(pa.array(pairs[:, 2]))], ["kind", "a", "b"]
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared, longer = [], [], []
            for row, (x, y) in enumerate(zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist())):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                n = max(len(x), len(y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                if common >= overlap_needed(n, threshold):
                    keep.append(row)
                    shared.append(common)
                    longer.append(n)
            if keep:
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("kind", "a", "b")), pa.array(shared, pa.int32()), pa.array(longer, pa.int32())],
                    ["kind", "a", "b", "shared", "longer"],
                )

    # a posting takes some 64 bytes and, in texts of any length, a third of the words are in prefixes
    parts = partitions_for(spark, n_words / 3 * 64)
    belonging = hashed.select("kind", "class_id", "key").distinct()
    posted = bodies.select("kind", "class_id", "words").mapInArrow(postings, "kind string, block long, side byte, n int, rest int, class_id binary, sign binary")
    posted = posted.repartition(parts, "block").sortWithinPartitions("block")
    candidates = posted.mapInArrow(compare, "kind string, a binary, b binary").distinct()
    once = bodies.groupBy("kind", "class_id").agg(F.first("words").alias("words"))
    both = candidates.join(once.select("kind", F.col("class_id").alias("a"), F.col("words").alias("wa")), ["kind", "a"])
    both = both.join(once.select("kind", F.col("class_id").alias("b"), F.col("words").alias("wb")), ["kind", "b"])
    pairs = both.select("kind", "a", "b", "wa", "wb").mapInArrow(verify, "kind string, a binary, b binary, shared int, longer int")
    return belonging, pairs


def key_pairs(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(kind, key_a, key_b) of all keys with texts at the threshold, key_a < key_b, each pair once.

    A thin expansion of class pairs and membership. A class of very many keys is divided into chunks of CHUNK_KEYS that
    are paired in separate tasks.
    """
    members, pairs = class_pairs(texts, threshold)
    sizes = members.groupBy("kind", "class_id").agg(F.count("*").alias("n")).where("n > 1")
    n_chunks = F.ceil(F.col("n") / F.lit(float(CHUNK_KEYS))).cast("int")
    hot = sizes.where(F.col("n") > CHUNK_KEYS).select("kind", "class_id", n_chunks.alias("n_chunks"))
    own = F.pmod(F.xxhash64("key"), F.col("n_chunks")).cast("int")
    # only classes of several keys have copies to pair
    shared = members.join(sizes.select("kind", "class_id", n_chunks.alias("n_chunks")), ["kind", "class_id"]).withColumn("own", own)
    spread = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    spread = spread.select("kind", "class_id", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    block = ["kind", "class_id", "i", "j"]
    one, two = spread.where("own = i").select(*block, F.col("key").alias("x")), spread.where("own = j").select(*block, F.col("key").alias("y"))
    copies = one.join(two, block).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("kind", "x", "y")
    salted = members.join(hot, ["kind", "class_id"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1))).withColumn("own", own)

    def with_keys(p: DataFrame, side: str, name: str) -> DataFrame:
        chunks = hot.withColumnRenamed("class_id", side)
        p = p.join(chunks, ["kind", side], "left").withColumn("own", F.explode(F.sequence(F.lit(0), F.coalesce("n_chunks", F.lit(1)) - 1))).drop("n_chunks")
        keys = salted.select("kind", F.col("class_id").alias(side), "own", F.col("key").alias(name))
        return p.join(keys, ["kind", side, "own"]).drop("own")

    across = with_keys(with_keys(pairs.select("kind", "a", "b"), "a", "x"), "b", "y").select("kind", "x", "y")
    found = across.where("x <> y").unionByName(copies.where("x <> y"))
    return found.select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(kind, key, group_id, links): the connected set of every key with words, named after its smallest key.

    `links` counts the links of the key's classes to different texts. Classes are joined by alternating large-star and
    small-star steps until nothing changes, however many it takes; every round is written to the shared checkpoint folder.
    """
    members, pairs = class_pairs(texts, threshold)
    members = checkpointed(members)
    links = checkpointed(pairs.select("kind", "a", "b"))
    degree = links.select("kind", F.explode(F.array("a", "b")).alias("class_id")).groupBy("kind", "class_id").agg(F.count("*").alias("links"))
    # a key with several texts ties their classes together
    ties = members.groupBy("kind", "key").agg(F.min("class_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    ties = members.join(ties.select("kind", "key", "a"), ["kind", "key"]).where("class_id <> a").select("kind", "a", F.col("class_id").alias("b"))
    edges = links.unionByName(ties).select("kind", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    before = _state(edges)
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        state = _state(edges)
        if state == before:
            break
        before = state
    named = members.join(edges.select("kind", F.col("v").alias("class_id"), F.col("u").alias("root")), ["kind", "class_id"], "left")
    named = named.withColumn("root", F.coalesce("root", "class_id")).join(degree, ["kind", "class_id"], "left")
    per_key = named.groupBy("kind", "key").agg(F.min("root").alias("root"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    names = per_key.groupBy("kind", "root").agg(F.min("key").alias("group_id"))
    return per_key.join(names, ["kind", "root"]).select("kind", "key", "group_id", "links")


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("kind", "u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select("kind", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("kind", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, ["kind", "u"]).select("kind", F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, tied to the smallest of them."""
    down = edges.select("kind", F.col("v").alias("node"), F.col("u").alias("low"))
    least = down.groupBy("kind", "node").agg(F.min("low").alias("m"))
    tied = down.join(least, ["kind", "node"])
    lows = tied.select("kind", F.col("m").alias("u"), F.col("low").alias("v"))
    nodes = least.select("kind", F.col("m").alias("u"), F.col("node").alias("v"))
    return lows.unionByName(nodes).where("u <> v").distinct()
