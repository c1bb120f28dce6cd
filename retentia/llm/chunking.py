"""Cutting oversized texts at natural boundaries.

Method: structure-tree packing. The text is parsed into a tree: sections under headings by level, blocks between blank
lines, markup elements, list items by indentation, lines, sentences, clauses, words, tokens. Sibling subtrees are
merged bottom-up as long as they fit; only a node over the limit is descended into, and what comes back from it is not
fused with its siblings. Where siblings need several pieces the largest is kept as small as the least number of pieces
allows, so no short tail is left behind a full piece. A heading belongs to what follows it: it is never a piece alone
unless nothing follows.

Defined results: null and blank texts and texts within the limit give no piece (or one, with `keep_whole`); repeated
rows are cut like any other; a text is never shortened: the new parts of its pieces, put together, are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One token: a run of word characters or of punctuation, ASCII classes.
TOKEN = re.compile(r"\w+|[^\w\s]+", re.ASCII)

_HEADING = re.compile(r"(#{1,6})(?=\s|$)")
_ITEM = re.compile(r"(?:[-*+•‣◦]|\d{1,3}[.)]|[a-zA-Z][.)])\s+")
_OPEN = re.compile(r"<([A-Za-z][\w:-]*)(?:\s[^<>]*)?>")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:—–][\"'”’»)\]]*$")


@dataclass
class Node:
    """Tokens start to end; children cover them without gaps. A leaf is cut by `ends`, only when it must be."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    ends: tuple = ()


@dataclass
class _Line:
    first: int  # tokens
    last: int
    indent: int
    level: int  # of a heading, else 0
    item: bool
    blank_before: bool
    text: str


def _lines(text: str, starts: list[int]) -> list[_Line]:
    """The lines that hold tokens; a token that crosses none belongs to the line it starts in."""
    out, at, blank = [], 0, False
    for raw in text.split("\n"):
        first, last = bisect_left(starts, at), bisect_left(starts, at + len(raw) + 1)
        at += len(raw) + 1
        if first == last:
            blank = blank or not raw.strip()
            continue
        body = raw.expandtabs(4)
        bare = body.lstrip()
        heading = _HEADING.match(bare)
        out.append(_Line(first, last, len(body) - len(bare), len(heading.group(1)) if heading else 0, bool(_ITEM.match(bare)), blank, bare))
        blank = False
    return out


def parse(text: str, spans: list[tuple[int, int]]) -> Node:
    """The structure tree of a text with tokens."""
    lines = _lines(text, [a for a, _ in spans])
    children = _sections(lines, text, spans)
    root = Node(0, len(spans), children)
    _close_gaps(root)
    return root


def _close_gaps(node: Node) -> None:
    """A child begins where the one before ends."""
    at = node.start
    for child in node.children:
        child.start = at
        at = child.end
        _close_gaps(child)
    if node.children:
        node.children[-1].end = node.end


def _sections(lines: list[_Line], text: str, spans: list[tuple[int, int]]) -> list[Node]:
    """Nodes of the lines: what stands before the first heading of the highest level, then a section for each of them."""
    levels = [l.level for l in lines if l.level]
    if not levels:
        return _blocks(lines, text, spans)
    top = min(levels)
    at = [i for i, l in enumerate(lines) if l.level == top]
    out = _sections(lines[: at[0]], text, spans) if at[0] else []
    for a, b in zip(at, [*at[1:], len(lines)]):
        body = _sections(lines[a + 1 : b], text, spans)
        section = Node(lines[a].first, lines[b - 1].last, body)
        if body:
            _lead(body[0], lines[a].first)
        else:
            section.ends = _ENDS
        out.append(section)
    return out


def _lead(node: Node, start: int) -> None:
    """Puts the tokens from `start` on at the head of a node and of its first leaf: a heading goes with what follows."""
    node.start = start
    if node.children:
        _lead(node.children[0], start)


#: Nested lists and elements deeper than this are read as plain lines.
DEPTH = 40


def _blocks(lines: list[_Line], text: str, spans: list[tuple[int, int]], depth: int = 0) -> list[Node]:
    """Blocks between blank lines; a markup element over several lines is one block."""
    groups: list[list[_Line]] = []
    unclosed: set[str] = set()
    i = 0
    while i < len(lines):
        opened = _OPEN.match(lines[i].text)
        end = i
        tag = opened.group(1) if opened else ""
        if opened and tag not in unclosed and not opened.group().endswith("/>"):
            start, close, open_ = re.compile(rf"<{re.escape(tag)}(?:\s[^<>]*)?>"), f"</{tag}>", 0
            for j in range(i, len(lines)):
                open_ += len(start.findall(lines[j].text)) - lines[j].text.count(close)
                if open_ <= 0:
                    end = j
                    break
            else:
                unclosed.add(tag)
        if end > i:
            groups.append(lines[i : end + 1])
            i = end + 1
            continue
        if groups and not lines[i].blank_before and groups[-1][-1] is lines[i - 1] and not (_OPEN.match(groups[-1][0].text) and len(groups[-1]) > 1):
            groups[-1].append(lines[i])
        else:
            groups.append([lines[i]])
        i += 1
    out = []
    for group in groups:
        if _OPEN.match(group[0].text) and len(group) > 2 and len(lines) > len(group) and depth < DEPTH:
            out.append(Node(group[0].first, group[-1].last, _blocks(group[1:-1], text, spans, depth + 1)))
            _lead(out[-1].children[0], group[0].first)
            out[-1].children[-1].end = group[-1].last
        else:
            out.append(Node(group[0].first, group[-1].last, _items(group)))
    return out


def _items(lines: list[_Line], depth: int = 0) -> list[Node]:
    """Lines by indentation: a line holds the deeper ones behind it; a list item holds its continuation lines."""
    if len(lines) == 1 or depth >= DEPTH:
        return [_leaf(l) for l in lines]
    least = min(l.indent for l in lines)
    heads = [i for i, l in enumerate(lines) if l.indent <= least]
    listed = any(lines[i].item for i in heads)
    if heads[0]:
        heads = [0, *heads]
    if listed:
        # text behind an item at the same depth goes on with it until the next item
        heads = [i for k, i in enumerate(heads) if not k or lines[i].item or lines[i].blank_before]
    out = []
    for a, b in zip(heads, [*heads[1:], len(lines)]):
        head = _leaf(lines[a])
        if b - a > 1:
            head = Node(head.start, lines[b - 1].last, [head, *_items(lines[a + 1 : b], depth + 1)])
        out.append(head)
    return out


#: What cuts a line: sentences, clauses, words.
_ENDS = (_SENTENCE_END, _CLAUSE_END, None)


def _leaf(line: _Line) -> Node:
    return Node(line.first, line.last, ends=_ENDS)


def _cut(node: Node, text: str, spans: list[tuple[int, int]]) -> list[Node]:
    """Children of a leaf, cut behind the tokens that match the first of its `ends` that cuts it (None: behind every word)."""
    for k, end in enumerate(node.ends):
        cuts = [node.start]
        for i in range(node.start, node.end - 1):
            a, b = spans[i]
            if spans[i + 1][0] > b and (end is None or end.search(text[a:b])):
                cuts.append(i + 1)
        if len(cuts) > 1:
            return [Node(a, b, ends=node.ends[k + 1 :]) for a, b in zip(cuts, [*cuts[1:], node.end])]
    return []


def _merge(sizes: list[int], limit: int) -> list[int]:
    """Numbers of siblings in each piece when they are merged from the left as long as they fit."""
    counts, used = [], limit + 1
    for n in sizes:
        if used + n > limit:
            counts.append(0)
            used = 0
        counts[-1] += 1
        used += n
    return counts


def _balanced(sizes: list[int], limit: int) -> list[int]:
    """The same number of pieces with the largest as small as it can be."""
    pieces = len(_merge(sizes, limit))
    low, high = max(sizes), limit
    while low < high:
        mid = (low + high) // 2
        if len(_merge(sizes, mid)) <= pieces:
            high = mid
        else:
            low = mid + 1
    return _merge(sizes, low)


def pack(node: Node, limit: int, text: str, spans: list[tuple[int, int]], free: int = 0) -> list[tuple[int, int]]:
    """Token ranges that cover a node, in order, of at most `limit` without the `free` first tokens of the text."""
    size = lambda n: max(n.end, free) - max(n.start, free)
    if size(node) <= limit:
        return [(node.start, node.end)]
    children = node.children or _cut(node, text, spans)
    if not children:
        n, at = size(node), max(node.start, free)
        parts = -(-n // limit)
        cuts = [node.start, *(at + n * k // parts for k in range(1, parts)), node.end]
        return list(zip(cuts, cuts[1:]))
    out: list[tuple[int, int]] = []
    run: list[Node] = []

    def close() -> None:
        at = 0
        for n in _balanced([size(c) for c in run], limit) if run else ():
            out.append((run[at].start, run[at + n - 1].end))
            at += n
        run.clear()

    for child in children:
        if size(child) <= limit:
            run.append(child)
        else:
            close()
            out.extend(pack(child, limit, text, spans, free))
    close()
    return out


def pieces(text: str, limit: int = 200, overlap: int = 20) -> list[tuple[int, int, int, int]]:
    """(first character, first new character, end, tokens) of each piece of `text`; one piece if it is within the limit.

    Each piece but the first begins with the last `overlap` tokens of the one before it. The first has nothing to
    repeat, so it may hold `limit` new tokens, the others `limit` - `overlap`.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, 0, len(text), len(spans))]
    ranges = pack(parse(text, spans), limit - overlap, text, spans, overlap)
    out = []
    for k, (a, b) in enumerate(ranges):
        first = max(0, a - overlap) if k else 0
        new = spans[a - 1][1] if k else 0
        end = spans[b - 1][1] if k + 1 < len(ranges) else len(text)
        out.append((spans[first][0] if k else 0, new, end, b - first))
    return out


def split_oversized(
    df: DataFrame, text: Column, item: list[Column], limit: int = 200, overlap: int = 20, keep_whole: bool = False
) -> DataFrame:
    """(item columns, piece_no, n_pieces, start_char, new_char, end_char, n_tokens, piece) of every text over `limit`.

    One pass without a shuffle; texts that cannot be over the limit are left out before they reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    slim = df.select(F.struct(*item).alias("item"), text.alias("text")).where(F.col("text").isNotNull())
    slim = slim.where(F.length(F.trim("text")) > 0) if keep_whole else slim.where(F.length("text") > limit)
    schema = T.StructType(
        [
            slim.schema["item"],
            *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "start_char", "new_char", "end_char", "n_tokens")),
            T.StructField("piece", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            columns: list[list] = [[] for _ in range(7)]
            for row, body in enumerate(batch.column("text").to_pylist()):
                found = pieces(body, limit, overlap)
                if len(found) == 1 and not keep_whole:
                    continue
                for k, (start, new, end, n) in enumerate(found):
                    rows.append(row)
                    for column, value in zip(columns, (k, len(found), start, new, end, n, body[start:end])):
                        column.append(value)
            if rows:
                arrays = [batch.column("item").take(pa.array(rows)), *(pa.array(c, pa.int32()) for c in columns[:6]), pa.array(columns[6], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    names = [f.name for f in slim.schema["item"].dataType.fields]
    cut_up = slim.mapInArrow(cut, schema)
    return cut_up.select(*(F.col("item")[c].alias(c) for c in names), *schema.names[1:])
