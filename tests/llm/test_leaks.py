import numpy as np
from pyspark.sql import functions as F

from retentia.llm import leaks as L

ITEM = [f"w{i}" for i in range(40)]


def passage(words, n=40):
    return L.extend([int(w[1:]) for w in ITEM], words, *words_at(words))


def words_at(words):
    for at in range(len(words) - L.SEED + 1):
        for i in range(len(ITEM) - L.SEED + 1):
            if words[at : at + L.SEED] == list(range(i, i + L.SEED)):
                return i, at
    raise AssertionError("no seed")


def test_edits_in_the_passage():
    assert passage([99, *range(0, 6), 77, *range(7, 14), 99])[:2] == (0, 14)
    assert passage([*range(0, 6), *range(7, 14)])[:2] == (0, 14)
    assert passage([*range(0, 7), 77, *range(7, 14)])[:2] == (0, 14)
    assert passage([*range(0, 7), 77, *range(8, 15), 78, *range(16, 23)])[:2] == (0, 23)
    # edits that stand too close end the passage
    first, last, *_ = passage([*range(0, 6), 77, *range(7, 10), 78, *range(11, 20)])
    assert last - first < 20


def test_shift_scan_finds_what_a_plain_scan_finds():
    rng = np.random.default_rng(1)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 60, 30))) for k in range(12)]
    patterns = L.Patterns(items)
    windows = {tuple(ids[a : a + L.SEED]) for ids in patterns.items for a in range(len(ids) - L.SEED + 1)}
    words = rng.integers(0, 61, 20000)
    for ids in patterns.items:
        at = rng.integers(0, 19900)
        words[at : at + len(ids)] = ids
    found = {e for e in patterns.ends(words).tolist() if tuple(words[e - L.SEED + 1 : e + 1].tolist()) in windows}
    plain = {e for e in range(L.SEED - 1, len(words)) if tuple(words[e - L.SEED + 1 : e + 1].tolist()) in windows}
    assert found == plain and plain


def test_markup_escapes_and_invisible_characters():
    text = "**The** <b>qu­ick</b> br​own&nbsp;fox\\njumps \\u006fver [the] _lazy_ dog-\ngie &amp;amp; co"
    assert L.words_of(text) == "the quick brown fox jumps over the lazy doggie co".split()


def test_operator(spark):
    body = " ".join(ITEM)
    docs = [
        (1, f"intro {' '.join(ITEM[3:20]).upper()} outro"), (2, " ".join(ITEM[3:12])), (3, None), (4, ""), (5, "... !!"), (1, f"again {' '.join(ITEM[0:12])}"),
        (6, " ".join(ITEM[:6] + ["other"] + ITEM[7:14])), (7, "x " * 20000 + body), (None, body),
    ]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, body), (11, body), (12, None), (13, "too short"), (10, body)], "item_id int, item_text string")
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in L.find_leaks(d, F.col("doc_id"), F.col("text"), items, "item_id", "item_text").collect()}
    assert got == {(x, i): n for i in (10, 11) for x, n in ((1, 17), (6, 14), (7, 40))}
    blocks = L.find_leaks(d, F.col("doc_id"), F.col("text"), items, "item_id", "item_text", block_items=1)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(got)
    assert L.find_leaks(d.limit(0), F.col("doc_id"), F.col("text"), items, "item_id", "item_text").count() == 0
    assert L.find_leaks(d, F.col("doc_id"), F.col("text"), items.limit(0), "item_id", "item_text").count() == 0


def test_long_tags_are_markup():
    tag = '<span data-note="' + "word " * 200 + '">'
    assert L.words_of(f"one {tag}two</span> three") == ["one", "two", "three"]


def test_many_hits_and_blocks(spark):
    """Every window of a text is a pattern; items are read in blocks of two."""
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(words[i * 20 : i * 20 + 40])) for i in range(19)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:17])), (3, " ".join(words[5:16]))], "d long, t string")
    ev = spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(df, F.col("d"), F.col("t"), ev, "item_id", "item_text", block_items=2).collect()}
    assert got == {(1, i) for i in range(19)} | {(2, 0)}
