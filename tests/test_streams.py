"""Streams in columns against numpy's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirescore.functions import signal as S
from wirescore.functions import streams as R

ITEMS = [0, 1, 2, 9, 4711, 2**31 - 1, 2**31, 2**32 - 1, 2**32, 2**45 + 17, 2**62 + 1]


@pytest.mark.parametrize("run", [0, 6, 2**33 + 1])
def test_seed_words(spark, run):
    df = spark.createDataFrame([(i,) for i in ITEMS], "i bigint").select("i", R.seed_words([F.lit(run), F.col("i")], 7).alias("w"))
    assert {r["i"]: r["w"] for r in df.collect()} == {i: [int(x) for x in np.random.SeedSequence([run, i]).generate_state(7)] for i in ITEMS}


def test_uniforms(spark):
    df = spark.createDataFrame([(i, n) for i, n in zip(ITEMS, [4, 0, 1, 40, 7, 3, 3, 2, 9, 5, 1], strict=True)], "i bigint, n int").select("i", "n", R.uniforms(F.col("i"), F.col("n")).alias("u"))
    assert all(r["u"] == np.random.default_rng(r["i"]).random(r["n"]).tolist() for r in df.collect())


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0])
def test_loss_is_that_of_the_bytes(spark, rate):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 255, n).tolist()) for i, n in zip(ITEMS[:8], [0, 1, 31, 32, 33, 400, 64, 65], strict=True)]
    df = spark.createDataFrame(rows, "i bigint, c array<int>")
    got = {r["i"]: r["x"] for r in df.select("i", R.without_lost(F.col("c"), F.col("i"), 0xD5, rate, 32, 4).alias("x")).collect()}
    assert got == {i: list(S.lost(bytes(c), "pcma", rate, 4, S.stream_seed(4, i))) for i, c in rows}
