"""MinHash near duplicates against all pairs of sets of strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirescore.llm import minhash_dedup as m


def brute(docs):
    """Set sizes and least doc_id reachable, over all pairs of rows."""
    sets = []
    for _, text in docs:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [d for j, (d, _) in enumerate(docs) if find(j) == find(i) and d is not None]
        low = min(ids, default=None)
        out.append((doc_id, len(sets[i]), low, doc_id == low))
    return sorted(out, key=str)


def crowd(seed=5):
    """Families of copies at all distances, chains among them, a passage that all of one family share, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    docs, at = [], 100
    for size, edits in [(60, 3), (60, 5), (40, 8), (30, 1)]:
        base = [word() for _ in range(120)]
        chain = base
        for k in range(size):
            copy = list(chain if k % 5 == 4 else base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            chain = copy
            docs.append((at := at + 1, " ".join(copy)))
    passage = " ".join(word() for _ in range(60))
    docs += [(at := at + 1, passage + " " + " ".join(word() for _ in range(rng.randint(5, 80)))) for _ in range(100)]
    docs += [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\x0btwo"), (8, "one two three"), (9, "Ünder ÜNDER"), (10, "ünder Ünder"),
        (None, "one two"), (None, "alone with null"), (11, docs[0][1]), (11, docs[0][1]), (12, "la " * 3000), (13, "la " * 40), (14, " ".join(f"t{i}" for i in range(9000))),
        (15, " ".join(f"t{i}" for i in range(9300))),
    ]
    rng.shuffle(docs)
    return docs


def test_against_all_pairs(spark):
    docs = crowd()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as keys", "2 as n", "'y' as row", "0 as bits").repartition(5)
    got = [tuple(r) for r in m.near_duplicates(frame).collect()]
    want = brute(docs)
    assert sorted(got, key=str) == want
    assert sum(not r[3] for r in want) > 100  # the case is no empty one


def test_places_of_texts_joined_by_a_shuffle(spark):
    docs = crowd()[::3]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in m.near_duplicates(frame, broadcast_ids=0).collect()), key=str) == brute(docs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(docs).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, m.near_duplicates(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def count(words):
    return int(np.bitwise_count(words.view(np.uint64)).sum())


def test_minima_estimate_and_bitmap_bound():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    for keep in (500, 800, 920, 990):
        other = np.unique(np.concatenate([base[:keep], rng.integers(0, 1 << 63, 1000 - keep).astype(np.uint64)]))
        common = len(np.intersect1d(base, other))
        true = common / (len(base) + len(other) - common)
        a, b = m.minima([base, other])
        assert abs((a == b).mean() - true) < 0.1
        x, y = m.bitmap(base), m.bitmap(other)
        differ = count(x ^ y)
        assert len(base) + len(other) - 2 * common >= differ > 0
        half = m.bitmap(base)
        folded = half[: len(half) // 2] | half[len(half) // 2 :]
        assert count(folded) <= count(half)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 100, 255, 256, 257, 2047, 2048, 2049, 50_000])
def test_bitmap_length_agrees_with_sql(spark, n):
    found = np.arange(n, dtype=np.uint64)
    length = spark.range(1).select(F.lit(n).cast("bigint").alias("n")).selectExpr(m._words_of("n")).first()[0]
    assert length == len(m.bitmap(found))


def test_strays_lose_no_similar_pair(spark):
    """Every pair of classes of different groups that is similar and shares a band gets through the bitmap bound."""
    docs = spark.createDataFrame(crowd(8), "doc_id long, text string")
    classes = m.materialise(m.classes_of(m.signed(docs)))
    bands = m.shared_bands(classes)
    none = spark.createDataFrame([], "node bigint, root bigint")
    got = {tuple(r) for r in m.strays(m.still_apart(bands, none), classes).collect()}
    known = m.Words()
    texts = {r.doc_id: m.shingle_set(r.text, known) for r in docs.collect()}
    rows = {r.id: (texts[r.doc_id], set(r["keys"])) for r in classes.collect()}
    want = set()
    for x, (a, p) in rows.items():
        for y, (b, q) in rows.items():
            both = len(np.intersect1d(a, b))
            if x < y and p & q and 100 * both >= 85 * (len(a) + len(b) - both):
                want.add((x, y))
    assert want and want <= got
