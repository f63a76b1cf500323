"""Elkan's bounds against plain Lloyd rounds in Python integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from wirescore.llm import vector_codes as v


def brute(rows, parts=4, entries=256, rounds=4):
    """Rows (vec_id, embedding, label): vec_id, code, error, label_error, digest."""
    kept = [(i, [math.floor(1024 * x) for x in e], lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(c[p], books[p])[1]].append(c[p])
            for j, members in held.items():
                books[p][j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    out, by_label = [], defaultdict(int)
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab])
        by_label[lab] += out[-1][2]
    return sorted(((i, code, e, by_label[lab], hashlib.sha256(text.encode()).hexdigest()) for i, code, e, lab in out), key=str)


def vectors(n, width, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, spread, (12, width))
    return [(int(i), [float(np.float32(x)) for x in at[i % 12] + rng.normal(0, 0.1, width)], int(i % 5) if i % 7 else None) for i in rng.permutation(n)]


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as code", "1 as kind", "2 as sums", "3 as n").repartition(3)
    return sorted((tuple(r) for r in v.vector_codes(frame).collect()), key=str)


def test_against_plain_rounds(spark):
    rows = vectors(420, 16, 1)
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [math.nan] * 16, 1), (1003, [math.inf] + [0.0] * 15, 2), (7, rows[0][1], 3), (7, rows[0][1], 3), (None, rows[1][1], None)]
    assert run(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(i, [float(i % 3), 0.0, float(i % 2), 1.0], 0) for i in range(300)]
    assert run(spark, rows) == brute(rows)
    few = vectors(9, 8, 2)
    assert run(spark, few) == brute(few)
    same = [(i, [0.25] * 4, i) for i in range(40)]
    assert run(spark, same) == brute(same)


def test_great_components_take_the_integer_path(spark):
    rows = [(i, [float(np.float32(x * 3000)) for x in e], lab) for i, e, lab in vectors(300, 8, 3)]
    assert run(spark, rows) == brute(rows)


def test_what_cannot_be_coded_stays_with_nulls(spark):
    rows = vectors(30, 8, 4)
    odd = [(2000, [1.0] * 7, 1), (2001, [1e30] + [0.0] * 7, 1), (2002, [], 1)]
    got = run(spark, rows + odd)
    assert [r[:3] for r in got if r[0] >= 2000] == [(i, None, None) for i in (2000, 2001, 2002)]
    assert [r for r in got if r[0] < 2000] == brute(rows)
    assert {r[1] for r in run(spark, [(1, [1.0] * 6, 1), (2, [1.0] * 8, 1)])} == {None}


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert v.vector_codes(frame).collect() == []
    assert v.vector_codes(spark.createDataFrame([(1, None, 2)], frame.schema)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_prune(seed):
    """After moves of any size, each upper bound is above and each lower bound below the true distance, and few entries are looked at."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-500, 500, (400, 6))
    x[::7] = x[0]
    book = v.Codebook(x[:32].copy())
    code, _, upper, lower = book.first(x)
    for _ in range(5):
        book = v.Codebook(book.entries + rng.integers(-20, 20, book.entries.shape), book.entries)
        code, best, upper, lower = book.again(x, code, upper, lower)
        true = v._distances(x, book.entries)
        assert (code == true.argmin(1)).all()
        assert (best[best >= 0] == true.min(1)[best >= 0]).all()
        assert (upper >= np.sqrt(true.min(1))).all() and (lower <= np.sqrt(true)).all()
