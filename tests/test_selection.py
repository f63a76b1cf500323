"""Nearest ranks by levels against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wirescore.operators.selection import nearest_ranks, order_key


def want(values, percent):
    kept = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    return kept[math.ceil(percent * len(kept) / 100) - 1] if kept else None


def same(a, b):
    return a == b or (a is not None and b is not None and a != a and b != b)


@pytest.mark.parametrize("most", [4096, 40, 0])
def test_against_sorting(spark, most):
    """Down to one value a place where most is 0: equal values share all their bits."""
    rng = random.Random(most)
    kinds = {
        "close": [1.0 + rng.randrange(50) * 2**-45 for _ in range(700)], "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(900)], "equal": [0.25] * 500,
        "odd": [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, 1.7e308, None], "none": [None] * 4, "one": [3.5], None: [float(i) for i in range(101)],
    }
    rows = [(k, v, -v if v is not None and rng.random() < 0.8 else None) for k, vs in kinds.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    got = {r["k"]: r for r in nearest_ranks(df, ["k"], ["a", "b"], (1, 50, 95, 100), most).collect()}
    assert set(got) == set(kinds)
    for k, r in got.items():
        for i, c in enumerate("ab", 1):
            for p in (1, 50, 95, 100):
                assert same(r[f"{c}_p{p}"], want([x[i] for x in rows if x[0] == k], p)), (k, c, p)


def test_without_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20, 0, -1)], "v double")
    assert tuple(nearest_ranks(df, [], ["v"], most=3).first()) == (10.0, 19.0)
    assert tuple(nearest_ranks(df.where("v < 0"), [], ["v"]).first()) == (None, None)


def test_keys_keep_the_order(spark):
    values = [float("-inf"), -1e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 0.1, 1.0, 1e300, float("inf"), float("nan")]
    keys = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(order_key(F.col("v"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
