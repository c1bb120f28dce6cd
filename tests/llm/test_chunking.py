from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.llm import chunking as C

PARTS = st.sampled_from(["word", "Ende.", "café,", "\n", "\n\n", "\n# Title\n", "\n- item", "\n  - deeper", " ", "...", "x" * 30, "\t", "<b>", "42"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=300), st.integers(4, 40))
def test_pieces_cover_the_text_within_the_limit(parts, limit):
    text = " ".join(parts)
    overlap = limit // 4
    found = C.pieces(text, limit, overlap)
    assert "".join(text[new:end] for _, new, end, _ in found) == text
    tokens = [m.span() for m in C.TOKEN.finditer(text)]
    for k, (start, new, end, n) in enumerate(found):
        own = C.TOKEN.findall(text[start:end])
        assert len(own) == n and (n <= limit)
        if k:
            before = [t for t in tokens if t[1] <= new]
            assert text[start:new] == text[before[-overlap][0] : new] if len(before) >= overlap else start == before[0][0]
    assert len(found) > 1 or len(tokens) <= limit


def test_cuts_at_the_strongest_boundary():
    block = " ".join(["alpha beta gamma."] * 10)
    text = f"# One\n{block}\n# Two\n{block}"
    ends = [text[:end].rstrip() for _, _, end, _ in C.pieces(text, 48, 4)]
    assert ends[0].endswith("gamma.") and "# Two" not in ends[0]


def cut(text, limit=200, overlap=20):
    return [text[new:end] for _, new, end, _ in C.pieces(text, limit, overlap)]


def test_a_heading_stays_with_its_text():
    section = lambda name, n: f"# {name}\n" + " ".join(["one two three four."] * n) + "\n"
    got = cut(section("A", 70) + section("B", 30) + section("C", 70))
    assert all(len(C.TOKEN.findall(p)) > 20 for p in got)
    for p in got:
        assert p.strip().count("#") <= 1 and ("#" not in p or p.strip().startswith("#"))


def test_oversized_sections_are_balanced_and_not_fused():
    got = [len(C.TOKEN.findall(p)) for p in cut("# A\n" + "one two three four. " * 80 + "\n# B\n" + "five six seven eight. " * 20)]
    assert max(got) - min(got[:-1]) < 40 and got[-1] == 102


def test_list_items_and_elements_stay_whole():
    items = "\n".join(f"- item {i} with a tail of words\n  goes on here" for i in range(40))
    assert all(p.strip().startswith("- item") for p in cut("Intro line.\n\n" + items)[1:])
    boxes = "\n".join(f"<box>\nline {i} of it\nsecond line\n</box>" for i in range(40))
    assert all(p.count("<box>") == p.count("</box>") for p in cut(boxes))


def test_the_first_piece_holds_the_limit():
    assert [n for *_, n in C.pieces("word " * 380)] == [200, 200]


def test_deep_and_broken_structure():
    deep = "\n".join(" " * i + "- x y" for i in range(900))
    assert "".join(cut(deep)) == deep
    broken = "<a>\n" * 3000
    assert "".join(cut(broken)) == broken


def test_operator_edges(spark):
    long = "A sentence of six words here. " * 400
    rows = [(1, 0, None), (2, 0, ""), (3, 0, "   "), (4, 0, "short"), (5, 0, long), (5, 0, long), (6, 0, "x" * 5000)]
    df = spark.createDataFrame(rows, "item int, piece_no int, text string")
    got = C.split_oversized(df, F.col("text"), [F.col("item"), F.col("piece_no").alias("n")])
    by = {}
    for r in got.collect():
        by.setdefault(r["item"], []).append(r)
    assert set(by) == {5}
    one = sorted(by[5], key=lambda r: r["piece_no"])
    assert len(one) == 2 * one[0]["n_pieces"] and max(r["n_tokens"] for r in one) <= 200
    kept = C.split_oversized(df, F.col("text"), [F.col("item")], keep_whole=True)
    assert {r["item"] for r in kept.select("item").distinct().collect()} == {4, 5, 6}
    assert C.split_oversized(df.limit(0), F.col("text"), [F.col("item")]).count() == 0
