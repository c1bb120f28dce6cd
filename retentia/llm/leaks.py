"""Evaluation passages inside a training corpus.

Method: Wu-Manber multi-pattern search over words. Every window of `SEED` words of the evaluation items is a pattern.
A shift table, indexed by a hash of the last two words under the cursor, says how many words the cursor may skip
because no pattern ends there; where the shift is 0 the suffix hash selects a bucket of patterns, and comparing words
confirms an occurrence. Cursors move over many stretches of text at once. Each occurrence is then extended to both
sides over single replaced, dropped or added words that lie at least `SPACING` passage words apart.

A passage of `min_words` words or more with such edits always holds `SEED` unbroken words, so no case is lost before
the extension. An edit at the first or last word of a passage leaves a passage without that word: twelve words with the
last one replaced are a quotation of eleven, no case. The evaluation items are read in blocks of bounded size; the
tables of a block are built once and broadcast (some 200 bytes a word of BLOCK_ITEMS items), and each block is one pass
over the corpus; no document leaves its task, and only (document, item) rows do.

Defined results: null, empty and wordless texts give no row; repeated documents or items give one row each; case,
punctuation, line layout, markup, escapes and invisible characters are removed from both sides first.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words of a pattern; of the passage between two edits.
SEED, SPACING = 5, 8
#: Items in one pass over the corpus, and words between two cursors' starts.
BLOCK_ITEMS, STRETCH = 20_000, 256
#: Candidates that are compared at once.
CANDIDATES = 1 << 20
#: Least and most bits of the shift table; it has about eight places a pattern, so that most of a text is skipped.
SHIFT_BITS = (16, 26)

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_INLINE_TAG = re.compile(r"</?(?:b|i|u|em|strong|span|a|code|mark|sub|sup|small|font|tt|q|s|del|ins)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_ESCAPE = re.compile(r"\\[nrtbf]")
_BROKEN = re.compile(r"(?<=[A-Za-z])-[ \t]*\r?\n[ \t]*(?=[a-z])")
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """The words of a text without markup, escapes and invisible characters, in lower case."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = _UNICODE_ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = _ESCAPE.sub(" ", text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace"), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


class Patterns:
    """Shift table, suffix buckets and words of a block of evaluation items, as arrays."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[list[int]] = []
        self.vocabulary: dict[str, int] = {}
        seen: dict[tuple[int, ...], list[int]] = {}
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            same = seen.setdefault(tuple(ids), [])
            same.append(key)
            if len(same) == 1:
                self.items.append(ids)
        self.keys = list(seen.values())
        sizes = np.array([max(0, len(ids) - SEED + 1) for ids in self.items], dtype=np.int64)
        n = int(sizes.sum())
        self.bits = int(min(SHIFT_BITS[1], max(SHIFT_BITS[0], (8 * n).bit_length())))
        self.shift = np.full(1 << self.bits, SEED - 1, dtype=np.int8)
        flat = np.array([w for ids in self.items for w in ids], dtype=np.int64)
        item = np.repeat(np.arange(len(self.items)), sizes)
        at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        lengths = np.array([len(ids) for ids in self.items], dtype=np.int64)
        starts = (np.cumsum(lengths) - lengths)[item] + at
        words = flat[starts[:, None] + np.arange(SEED)] if n else np.empty((0, SEED), dtype=np.int64)
        for last in range(1, SEED) if n else ():
            np.minimum.at(self.shift, self.hash(words[:, last - 1], words[:, last]), np.int8(SEED - 1 - last))
        suffix = self.hash(words[:, -2], words[:, -1])
        order = np.argsort(suffix, kind="stable")
        #: Buckets: patterns in the order of their suffix hash.
        self.suffix, self.item, self.at, self.words = suffix[order], item[order], at[order], words[order].astype(np.int32)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed ^= mixed >> np.uint64(29)
            return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ends(self, words: np.ndarray) -> np.ndarray:
        """Sorted positions in `words` where the shift is 0; words outside the vocabulary are 0."""
        n = len(words)
        if n < SEED:
            return np.empty(0, dtype=np.int64)
        cursor = np.arange(SEED - 1, n, STRETCH, dtype=np.int64)
        stop = np.minimum(cursor + STRETCH, n)
        found = []
        while len(cursor):
            a, b = words[cursor - 1], words[cursor]
            step = self.shift[self.hash(a, b)]
            step[b <= 0] = SEED - 1
            hit = step == 0
            if hit.any():
                found.append(cursor[hit])
            cursor = cursor + np.maximum(step, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)

    def occurrences(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last position, pattern) of every pattern that stands in `words`, all its words compared."""
        ends = self.ends(words)
        h = self.hash(words[ends - 1], words[ends])
        low, high = np.searchsorted(self.suffix, h, side="left"), np.searchsorted(self.suffix, h, side="right")
        n = high - low
        out_end, out_pattern = [], []
        # buckets of any size, in bounded steps
        bounds = np.searchsorted(np.cumsum(n), np.arange(CANDIDATES, int(n.sum()) + CANDIDATES, CANDIDATES), side="left") + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(n)]):
            if b <= a:
                continue
            own = n[a:b]
            pattern = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[a:b], own)
            end = np.repeat(ends[a:b], own)
            same = np.ones(len(end), dtype=bool)
            for k in range(SEED):
                same[same] = words[end[same] - (SEED - 1 - k)] == self.words[pattern[same], k]
            out_end.append(end[same])
            out_pattern.append(pattern[same])
        empty = np.empty(0, dtype=np.int64)
        return (np.concatenate(out_end), np.concatenate(out_pattern)) if out_end else (empty, empty)

    def search(self, words: np.ndarray, starts: np.ndarray, min_words: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, first item word, item words, edits) of each item found in each text.

        `words`: the texts' word ids one after another, a -1 between texts; `starts`: where each text begins.
        """
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        covered: dict[tuple[int, int, int], int] = {}
        ends, patterns = self.occurrences(words)
        if not len(ends):
            return
        text_of = np.searchsorted(starts, ends, side="right") - 1
        bounds = np.append(starts, len(words) + 1)
        now, doc = -1, []
        for end, text, n, item_at in zip(ends.tolist(), text_of.tolist(), self.item[patterns].tolist(), self.at[patterns].tolist()):
            lo = int(bounds[text])
            at = end - SEED + 1
            diagonal = (text, n, at - item_at)
            if at < lo or covered.get(diagonal, -1) >= end:
                continue
            if text != now:
                now, doc = text, words[lo : int(bounds[text + 1]) - 1].tolist()
            first, last, edits, run_end = extend(self.items[n], doc, item_at, at - lo)
            covered[diagonal] = lo + run_end
            size = last - first
            if size >= min_words and size > best.get((text, n), (0, 0, 0))[1]:
                best[text, n] = (first, size, edits)
        for (text, n), (first, size, edits) in best.items():
            yield text, n, first, size, edits


def _run(a: list[int], b: list[int], i: int, j: int, way: int) -> int:
    """Equal words from a[i], b[j] on in direction `way`."""
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        i, j, n = i + way, j + way, n + 1
    return n


def _grow(a: list[int], b: list[int], i: int, j: int, way: int) -> tuple[int, int]:
    """(item words gained, edits) beyond the mismatch at a[i], b[j], over edits spaced as allowed."""
    best = (0, 0)
    for da, db in ((1, 1), (1, 0), (0, 1)):
        x, y = i + da * way, j + db * way
        run = _run(a, b, x, y, way)
        if not run:
            continue
        gained, edits = da + run, 1
        if run >= SPACING - 1:
            more, extra = _grow(a, b, x + run * way, y + run * way, way)
            gained, edits = gained + more, edits + extra
        best = max(best, (gained, edits), key=lambda t: (t[0], -t[1]))
    return best


def extend(item: list[int], doc: list[int], i: int, j: int) -> tuple[int, int, int, int]:
    """(first item word, one past the last, edits, end of the unbroken run in `doc`) around equal words at i, j."""
    ahead, back = _run(item, doc, i, j, 1), _run(item, doc, i - 1, j - 1, -1)
    first, last = i - back, i + ahead
    right, right_edits = _grow(item, doc, last, j + ahead, 1)
    left, left_edits = _grow(item, doc, first - 1, j - back - 1, -1)
    if left and right and last - first < SPACING - 1:
        if left > right:
            right = right_edits = 0
        else:
            left = left_edits = 0
    return first - left, last + right, left_edits + right_edits, j + ahead


def find_leaks(
    documents: DataFrame,
    doc_id: Column,
    text: Column,
    items: DataFrame,
    item_id: str,
    item_text: str,
    min_words: int = 12,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_edits): the longest passage of each item in each document that has one."""
    wanted = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    n_blocks = max(1, -(-wanted.count() // block_items))
    slim = documents.select(doc_id.alias("doc_id"), text.alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    key_type, doc_type = wanted.schema["k"].dataType, slim.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", doc_type), T.StructField("item_id", key_type), *(T.StructField(c, T.IntegerType()) for c in ("first_word", "n_words", "n_edits"))]
    )
    found = None
    for block in range(n_blocks):
        rows = wanted.where(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == block).collect()
        tables = documents.sparkSession.sparkContext.broadcast(Patterns([(r["k"], r["t"]) for r in rows]))
        one = slim.mapInArrow(_searcher(tables, min_words, schema.names, to_arrow_type(key_type)), schema)
        found = one if found is None else found.unionByName(one)
    best = F.max_by(F.struct("first_word", "n_words", "n_edits"), F.struct("n_words", -F.col("n_edits"), -F.col("first_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _searcher(tables: Broadcast, min_words: int, names: list[str], key_type: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tables.value
        known = patterns.vocabulary.get
        for batch in batches:
            flat: list[int] = []
            starts: list[int] = []
            for body in batch.column("text").to_pylist():
                starts.append(len(flat))
                flat.extend([known(w, 0) for w in words_of(body)])
                flat.append(-1)
            if not flat:
                continue
            out: list[tuple] = []
            hits = patterns.search(np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64), min_words)
            for row, n, first, size, edits in hits:
                out.extend((row, key, first, size, edits) for key in patterns.keys[n])
            if out:
                rows, keys, *numbers = zip(*out)
                arrays = [batch.column("doc_id").take(pa.array(rows)), pa.array(keys, key_type), *(pa.array(x, pa.int32()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return search
