import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from retentia.llm import neardup as N


def words(t):
    return re.findall("[a-z0-9]+", t.lower()) if t else []


def brute(rows):
    texts = [(kind, key, Counter(words(t)), len(words(t))) for kind, key, t in rows if t and key is not None and words(t)]
    out = set()
    for i, (kind, x, a, n) in enumerate(texts):
        for kind2, y, b, m in texts[:i]:
            if kind == kind2 and x != y and sum((a & b).values()) >= math.ceil(0.8 * max(n, m) - 1e-9):
                out.add((kind, min(x, y), max(x, y)))
    return out


def corpus(n=260, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            base = words(rows[rng.integers(len(rows))][2]) or ["empty"]
            for _ in range(rng.integers(0, 5)):
                base = base or ["empty"]
                at = rng.integers(len(base))
                act = rng.integers(3)
                base = base[:at] + ([vocabulary[rng.integers(400)]] if act < 2 else []) + base[at + (act != 1) :]
            if rng.random() < 0.3:
                base = list(rng.permutation(base))
        else:
            base = [vocabulary[int(rng.integers(400) * rng.random())] for _ in range(rng.integers(1, 40))]
        rows.append((("memory", "fact")[k % 2], f"k{k - (k % 7 == 0)}", " ".join(base)))
    return rows


SCHEMA = "kind string, key string, text string"


@pytest.mark.parametrize("chunk", [4096, 8])
def test_same_pairs_as_brute_force(spark, chunk, monkeypatch):
    rows = corpus()
    members, pairs = N.class_pairs(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk=chunk)
    of = defaultdict(set)
    for r in members.collect():
        of[r["kind"], r["class_id"]].add(r["key"])
    found = {(k, min(x, y), max(x, y)) for (k, _), keys in of.items() for x in keys for y in keys if x != y}
    for r in pairs.collect():
        found |= {(r["kind"], min(x, y), max(x, y)) for x in of[r["kind"], r["a"]] for y in of[r["kind"], r["b"]] if x != y}
    assert found == brute(rows)
    assert N.key_pairs(spark.createDataFrame(rows, SCHEMA)).count() == len(found)


def test_nulls_blanks_copies_and_long_texts(spark):
    long = " ".join(f"t{i}" for i in range(6000))
    rows = [("m", "a", None), ("m", "b", ""), ("m", "c", "!!!"), ("m", None, "x y"), ("m", "d", "x y"), ("m", "e", "Y, x"), ("m", "d", "x y"), ("m", "f", long), ("m", "g", long + " more"), ("o", "h", "x y")]
    got = {tuple(r) for r in N.key_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("m", "d", "e"), ("m", "f", "g")}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.key_pairs(empty).count() == 0
    assert N.near_duplicate_groups(empty).count() == 0


def test_groups_are_the_connected_sets(spark):
    rows = corpus(120, 5)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for kind, x, y in brute(rows):
        parent[find((kind, x))] = find((kind, y))
    expected = defaultdict(set)
    for kind, key, text in rows:
        if words(text):
            expected[find((kind, key))].add((kind, key))
    got = defaultdict(set)
    for r in N.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["kind"], r["group_id"]].add((r["kind"], r["key"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_bit_sliced_counts(spark):
    rng = np.random.default_rng(2)
    differ = rng.integers(0, 2, (128, 640)).astype(np.uint8)
    differ[:, ::3] &= rng.integers(0, 2, (128, 214)).astype(np.uint8) & rng.integers(0, 2, (128, 214)).astype(np.uint8)
    planes = np.packbits(differ, axis=1, bitorder="little").view("<u8")
    radius = rng.integers(-1, 90, 640)
    assert (N._within(planes, radius) == ((differ.sum(axis=0) <= radius) & (radius >= 0))).all()


def test_signature_distance_is_a_lower_bound():
    texts = [t for _, _, t in corpus(60, 9)]
    hashes, sizes = N.hashed_words(texts)
    sign = np.unpackbits(N.signatures(hashes, sizes), axis=1)
    for i in range(60):
        for j in range(i):
            a, b = Counter(words(texts[i])), Counter(words(texts[j]))
            assert (sign[i] != sign[j]).sum() <= sum((a - b).values()) + sum((b - a).values())


def long_corpus(n=70, seed=8):
    """Texts of 40 to 700 words in families whose members differ in up to a quarter of their words and in length."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k % 5:
            base = words(rows[-1][2])
            gone = rng.random(len(base)) < rng.choice([0.02, 0.1, 0.19, 0.25])
            base = [w for w, g in zip(base, gone) if not g or rng.random() < 0.4] + [f"x{rng.integers(4000)}" for _ in range(rng.integers(0, 9))]
            base = base or ["empty"]
        else:
            base = [f"v{int(rng.integers(3000) * rng.random())}" for _ in range(rng.integers(40, 700))]
        rows.append(("m", f"k{k}", " ".join(base)))
    return rows


@pytest.mark.parametrize("chunk", [4096, 4])
def test_long_texts_across_length_classes(spark, chunk):
    rows = long_corpus()
    members, pairs = N.class_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk)
    of = {r["class_id"]: r["key"] for r in members.collect()}
    found = {("m", *sorted((of[r["a"]], of[r["b"]]))) for r in pairs.collect()}
    assert found == brute(rows) and len(found) > 30
    lengths = {r[1]: len(words(r[2])) for r in rows}
    assert any(N.length_class(np.array([lengths[a]])) != N.length_class(np.array([lengths[b]])) for _, a, b in found)


def test_wide_signatures_tell_long_texts_apart():
    """Unrelated texts of 2,000 words stay far beyond the radius."""
    a, b = (" ".join(f"{c}{i}" for i in range(2000)) for c in "ab")
    hashes, sizes = N.hashed_words([a, b])
    width = N.PLANES << int(N.length_class(np.array([2000]))[0])
    sign = np.unpackbits(N.signatures(hashes, sizes, width), axis=1)
    assert (sign[0] != sign[1]).sum() > 1.5 * (4000 - 2 * 1600)
    half = np.unpackbits(N.folded(N.signatures(hashes, sizes, width)), axis=1)
    assert (half == np.unpackbits(N.signatures(hashes, sizes, width // 2), axis=1)).all()


def test_hot_class_is_paired_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_KEYS", 5)
    rows = [("m", f"k{i:02}", "one two three four five six") for i in range(23)] + [("m", "n", "one two three four five"), ("m", "z", "other words here")]
    got = {tuple(r) for r in N.key_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(got) == 23 * 22 // 2 + 23
