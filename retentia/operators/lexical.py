"""Lexical search: BM25 and substrings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B, EPSILON = 1.5, 0.75, 0.25


def words(text: Column) -> Column:
    """Words of the lower-cased text; an empty array where there is none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


#: Different query words that may be broadcast; more are joined by shuffling, with the same result.
BROADCAST_WORDS = 1 << 20


def bm25(documents: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by Okapi BM25, score at six decimals, ties by doc.

    Document frequencies and the floor of negative idf come from all documents, as one count a task and word; postings
    of other words than the queries' never leave their task. A word that a query repeats counts as often. Documents that
    share no word score 0 and stay out.
    """
    tokens = documents.select(F.col(doc).alias("d"), words(F.col(text)).alias("w")).where("d IS NOT NULL")
    stats = tokens.agg(F.count("*").alias("N"), F.avg(F.size("w")).alias("avgdl"))
    df = tokens.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    floor = idf.agg((F.lit(EPSILON) * F.avg("idf")).alias("low"))
    wanted = queries.select(F.col(query).alias("q"), F.explode(words(F.col(query_text))).alias("word")).groupBy("q", "word").agg(F.count("*").alias("times"))
    asked = wanted.select("word").distinct()
    if asked.count() <= BROADCAST_WORDS:
        asked = F.broadcast(asked)
    postings = tokens.select("d", F.size("w").alias("n"), F.explode("w").alias("word")).join(asked, "word", "left_semi")
    postings = postings.groupBy("word", "d", "n").agg(F.count("*").alias("tf"))
    terms = wanted.join(idf, "word").crossJoin(F.broadcast(floor)).withColumn("idf", F.when(F.col("idf") < 0, F.col("low")).otherwise(F.col("idf")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avgdl")))
    scores = postings.join(terms.select("q", "word", "times", "idf", "avgdl"), "word").groupBy("q", "d").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query), F.col("d").alias(doc), "score", "rank")


#: Patterns that one pass over the texts looks for.
BLOCK_PATTERNS = 20_000


def contains_any(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, pattern: str) -> DataFrame:
    """(item, doc) of every text that holds an item's pattern as a substring, each pair once.

    A multi-pattern automaton over blocks of patterns; each block is one pass and no text leaves its task. Null or empty
    patterns and null texts give no row.
    """
    wanted = items.where(F.length(pattern) > 0).select(F.col(item).alias("item"), F.col(pattern).alias("pattern")).distinct()
    blocks = max(1, -(-wanted.count() // BLOCK_PATTERNS))
    slim = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("item", wanted.schema["item"].dataType), T.StructField("doc", slim.schema["doc"].dataType)])
    found = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item", "pattern"), F.lit(blocks)) == block).toArrow()
        one = slim.mapInArrow(_matcher(rows), schema)
        found = one if found is None else found.unionByName(one)
    return found.distinct().select(F.col("item").alias(item), F.col("doc").alias(doc))


def _matcher(rows: pa.Table):
    items = rows["item"].combine_chunks()
    of: dict[str, list[int]] = {}
    for i, p in enumerate(rows["pattern"].to_pylist()):
        of.setdefault(p, []).append(i)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p, own in of.items():
            machine.add_word(p, own)
        machine.make_automaton()
        for batch in batches:
            at, which = [], []
            for row, body in enumerate(batch.column("text").to_pylist()):
                hit = {i for _, own in machine.iter(body) for i in own} if of else ()
                at.extend([row] * len(hit))
                which.extend(hit)
            if at:
                yield pa.RecordBatch.from_arrays([items.take(pa.array(which)), batch.column("doc").take(pa.array(at))], ["item", "doc"])

    return match


#: Rows and characters of a block of `nearest_bag`.
BLOCK_BAGS, BLOCK_CHARS = 16384, 1 << 24
#: Rows up to which small groups are compared in one matrix, and cells of a matrix.
TOGETHER, CELLS = 512, 1 << 22
#: Words that are compared as columns of a matrix at most; others, and those that fewer than 1 in 20 rows hold, by postings.
COLUMNS = 1024


def nearest_bag(df: DataFrame, group: list[str], key: str, text: str, counted: DataFrame | None = None) -> DataFrame:
    """(key, other, f1): the other row of each row's group with the highest token F1, f1 at six decimals, the first key of equals.

    Keys are unique. A group is divided into blocks by a hash of the key and every pair of blocks is compared in a task of
    its own, all pairs in matrices: only words and each row's best of a block travel, never a pair. Rows that share no word
    with another are left out, and null groups. `counted`, if given, stands for `df` in counting the rows of a group and
    may hold more.
    """
    e = df.dropna(subset=[*group, key]).select(*group, F.col(key).alias("k"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK_BAGS)), F.sum(F.length(text)) / F.lit(float(BLOCK_CHARS)))).cast("int")
    large = (df if counted is None else counted).groupBy(*group).agg(n.alias("n")).where("n > 1")
    e = e.join(F.broadcast(large), group, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    e = e.withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    task = [*group, "i", "j"]
    e = e.select(*group, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "k", F.array_join("w", " ").alias("w"))
    kind = e.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("other", kind), T.StructField("f1", T.LongType())])
    found = e.repartition(*task).sortWithinPartitions(*task, "own", "k").mapInArrow(_bag_finder(task), schema)
    best = found.groupBy("k").agg(F.min(F.struct((-F.col("f1")).alias("f1"), "other")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("b.other").alias("other"), (-F.col("b.f1") / F.lit(1e6)).alias("f1"))


def _bag_finder(task: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
                starts = _starts(held, task)
                if starts[-1]:
                    yield _best_bags(held.slice(0, starts[-1]), starts[:-1])
                    held = held.slice(starts[-1])
        if held is not None:
            yield _best_bags(held, np.zeros(1, dtype=np.int64))

    return find


def _starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before, and 0."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for c in columns:
        x = rows[c].combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _best_bags(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """(k, other, f1 in millionths): the best of each row within its task; tasks begin at `starts`, rows are in order of own and k."""
    keys, w = rows["k"].combine_chunks(), pc.split_pattern(rows["w"].combine_chunks(), " ")
    size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
    code = w.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    own, other = rows["own"].to_numpy(), np.stack([rows["i"].to_numpy(), rows["j"].to_numpy()])
    ends, unit = [*starts[1:].tolist(), len(size)], []
    xs, ys, f1 = [], [], []

    def compare(spans: list[tuple[int, int]]) -> None:
        a, b = spans[0][0], spans[-1][1]
        of = np.repeat(np.arange(len(spans)), [q - p for p, q in spans])
        word, row = _occurrences(code[first[a] : first[b]], np.repeat(np.arange(b - a), size[a:b]), of)
        cut = int((own[a:b] == other[0, a]).sum())
        sides = [(slice(0, b - a), slice(0, b - a))] if other[0, a] == other[1, a] else [(slice(0, cut), slice(cut, b - a)), (slice(cut, b - a), slice(0, cut))]
        for x, y in sides:
            best, at = _best_shared(word, row, size[a:b], x, y)
            hit = np.flatnonzero(best)
            xs.append(a + x.start + hit)
            ys.append(a + y.start + at[hit])
            f1.append(best[hit])

    for span in zip(starts.tolist(), ends):
        alone = other[0, span[0]] != other[1, span[0]]
        if unit and (alone or span[1] - unit[0][0] > TOGETHER):
            compare(unit)
            unit = []
        unit.append(span)
        if alone:
            compare(unit)
            unit = []
    if unit:
        compare(unit)
    take = lambda parts: keys.take(pa.array(np.concatenate(parts)))
    return pa.RecordBatch.from_arrays([take(xs), take(ys), pa.array(np.concatenate(f1), pa.int64())], ["k", "other", "f1"])


def _occurrences(code: np.ndarray, row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) in order of row: a number for each word of a group and time it occurs in a row, so that equal numbers are shared words."""
    at = np.lexsort((code, row))
    code, row = code[at], row[at]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(code))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    word = (of[row] * (code.max() + 1) + code) * (nth.max() + 1) + nth
    return np.unique(word, return_inverse=True)[1], row


def _best_shared(word: np.ndarray, row: np.ndarray, size: np.ndarray, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
    """The highest F1 of each row of x with another of y, in millionths, 0 where no word is shared, and the first row of y that has it."""
    width, n_x = y.stop - y.start, x.stop - x.start
    best, who = np.zeros(n_x, dtype=np.int64), np.zeros(n_x, dtype=np.int64)
    if not width or not n_x:
        return best, who
    order = np.argsort(size[y], kind="stable")  # columns: by size, then key
    column = np.empty(width, dtype=np.int64)
    column[order] = np.arange(width)
    sizes = size[y][order]
    bounds = np.flatnonzero(np.diff(sizes, prepend=-1))
    by_size = len(bounds) * 8 <= width and size.max() < 250_000  # else unlike counts of one size can give equal F1 at six decimals
    spans = list(zip(bounds.tolist(), [*bounds[1:].tolist(), width]))
    in_y = (row >= y.start) & (row < y.stop)
    word_y, column_y = word[in_y], column[row[in_y] - y.start]
    held = np.bincount(word_y, minlength=int(word.max()) + 1)
    often = np.flatnonzero(held * 20 > width)
    often = often[np.argsort(-held[often], kind="stable")[:COLUMNS]]
    place = np.full(len(held), -1)
    place[often] = np.arange(len(often))
    matrix, p = np.zeros((len(often), width), dtype=np.float32), place[word_y]
    matrix[p[p >= 0], column_y[p >= 0]] = 1
    posted, start = column_y[np.argsort(word_y, kind="stable")], np.cumsum(held) - held
    in_x = (row >= x.start) & (row < x.stop)
    word_x, row_x = word[in_x], row[in_x] - x.start
    work = np.concatenate([[0], np.cumsum(np.bincount(row_x, np.where(place[word_x] < 0, held[word_x], 0), minlength=n_x))])
    a = 0
    while a < n_x:
        b = max(a + 1, min(n_x, a + CELLS // width, int(np.searchsorted(work, work[a] + CELLS, "right")) - 1))
        some = slice(*np.searchsorted(row_x, [a, b]))
        w, r = word_x[some], row_x[some] - a
        p = place[w]
        mine = np.zeros((b - a, len(often)), dtype=np.float32)
        mine[r[p >= 0], p[p >= 0]] = 1
        shared = mine @ matrix
        w, r = w[p < 0], r[p < 0]
        n = held[w]
        cell = np.repeat(r * width, n) + posted[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        np.add.at(shared.reshape(-1), cell, np.float32(1))
        if x == y:
            shared[np.arange(b - a), column[a:b]] = 0
        if by_size:  # of one size the most shared words are best
            top = np.stack([p + shared[:, p:q].argmax(axis=1) for p, q in spans], axis=1)
            count, total, rows = np.take_along_axis(shared, top, 1).astype(np.int64), sizes[bounds], order[top]
        else:
            count, total, rows = shared.astype(np.int64), sizes, order[None, :]
        total = size[x][a:b, None] + total[None, :]
        f1 = np.where(count > 0, (4_000_000 * count + total) // (2 * total), 0)
        best[a:b] = f1.max(axis=1)
        who[a:b] = np.where(f1 == best[a:b, None], rows, width).min(axis=1)
        a = b
    return best, who
