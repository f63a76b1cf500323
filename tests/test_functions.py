import numpy as np
import pytest
from pyspark.sql import functions as F

from wirescore.functions import signal as S
from wirescore.functions import text as T
from wirescore.operators import metrics as M


def test_normalised():
    assert T.normalised("\tGröße: ＡＢ-12,  «Да»… x²  ") == "grösse ab 12 да x2"


@pytest.mark.parametrize(("r", "h", "edits", "units"), [("der Hund schläft heute", "der Hund, schlief heute", 1, 4), ("", "", 0, 0), ("", "so ein Ding", 3, 0), ("nichts da", "", 2, 2), ("alpha", "beta gamma", 2, 1), ("a b c d e", "b c e d", 3, 5)])
def test_word_edits(spark, r, h, edits, units):
    row = M.scored(spark.createDataFrame([(r, h)], "reference string, hypothesis string")).first()
    assert (row["word_edits"], row["word_units"]) == (edits, units)


def test_character_edits(spark):
    row = M.scored(spark.createDataFrame([("N. i-l", "nul")], "reference string, hypothesis string")).first()
    assert (row["char_edits"], row["char_units"]) == (1, 3)


def test_bit_vectors_against_plain_tables():
    """Short pairs and pairs of more words than a machine word has bits."""
    import random

    rng = random.Random(4)
    sizes = [(rng.randrange(12), rng.randrange(12), 9) for _ in range(200)] + [(rng.randrange(60, 200), rng.randrange(60, 200), k) for k in (2, 5, 50) for _ in range(5)]
    for n, m, k in sizes:
        a, b = ([rng.randrange(k) for _ in range(x)] for x in (n, m))
        edits, common = [list(range(m + 1))], [[0] * (m + 1)]
        for i, x in enumerate(a, 1):
            edits.append([i])
            common.append([0])
            for j, y in enumerate(b, 1):
                edits[i].append(min(edits[i - 1][j] + 1, edits[i][j - 1] + 1, edits[i - 1][j - 1] + (x != y)))
                common[i].append(common[i - 1][j - 1] + 1 if x == y else max(common[i - 1][j], common[i][j - 1]))
        assert T.distance(a, b) == edits[-1][-1] and T.common_length(a, b) == common[-1][-1]


def test_edits_of_long_pairs(spark):
    long = [str(i) for i in range(18_000)]
    other = ["x", *long[:9000], "y", *long[9002:]]
    df = spark.createDataFrame([(long, other), (["p"], ["q"]), (None, ["q"]), (["q"], None), ([], [])], "a array<string>, b array<string>")
    assert [tuple(r) for r in df.select(T.word_edits(F.col("a"), F.col("b")), T.lcs_length(F.col("a"), F.col("b"))).collect()] == [(3, 17_998), (1, 0), (None, None), (None, None), (0, 0)]


def test_entities(spark):
    df = spark.createDataFrame([("call 8 (495) 555-00-11 or box 007, a1b 12c 9",)], "t string")
    found = df.select(T.numeric_entities(F.col("t")).alias("e")).first()["e"]
    assert [(e["kind"], e["canonical"]) for e in found] == [("phone", "84955550011"), ("number", "007"), ("number", "9")]


@pytest.mark.parametrize(("a", "b", "n"), [(["5", "7", "7"], ["7", "5", "7"], 2), (["a", "b", "c", "d"], ["b", "x", "d"], 2), (["3"], ["4"], 0), ([], ["8"], 0), (["8"], [], 0)])
def test_lcs(spark, a, b, n):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(T.lcs_length(F.col("a"), F.col("b"))).first()[0] == n


@pytest.mark.parametrize(("law", "back", "silence", "fine"), [(S.mu_law, S.mu_law_decode, 0xFF, 4), (S.a_law, S.a_law_decode, 0xD5, 8)])
def test_codes_are_near_and_in_order(spark, law, back, silence, fine):
    """A decoded sample is within half a step of its segment, about a 32nd of its size; louder samples never have smaller values."""
    pcm = list(range(-32000, 32001, 61))
    df = spark.createDataFrame([(pcm,), ([0],)], "p array<int>").select(law(F.col("p")).alias("c"))
    (codes,), (zero,) = df.collect()
    decoded = [round(x * 32768) for x in spark.createDataFrame([(codes,)], "c array<int>").select(back(F.col("c"))).first()[0]]
    assert list(zero) == [silence] and len(set(codes)) > 150
    assert decoded == sorted(decoded) and all(abs(x - y) <= (abs(x) + 132) / 32 + fine for x, y in zip(pcm, decoded, strict=True))


def test_gain_and_clip(spark):
    df = spark.createDataFrame([([0.2, -0.1, 0.9, -0.9],)], "s array<float>")
    assert np.allclose(df.select(S.gain_and_clip(F.col("s"), 20.0, 1.5)).first()[0], [1.5, -1.0, 1.5, -1.5], atol=1e-5)


def test_frames(spark):
    df = spark.createDataFrame([(list(range(17)),), ([],)], "s array<int>")
    assert [[len(f) for f in r[0]] for r in df.select(S.frames(F.col("s"), 5)).collect()] == [[5, 5, 5, 2], []]


def test_loss_is_seeded():
    payload = bytes(range(44))
    out, gone = S.lost(payload, "pcmu", 0.4, 2, 3), np.random.default_rng(3).random(3) < 0.4
    assert [out[i : i + 16] == payload[i : i + 16] for i in (0, 16, 32)] == (~gone).tolist() and set(out[i] for i in range(44) if gone[i // 16]) <= {255}
    assert S.lost(b"ab" * 15, "pcma", 1.0, 1) == b"\xd5" * 30
    out, gone = S.late(payload, "pcma", 8.0, 2.0, 2, 6), np.random.default_rng(6).normal(0, 8.0, 3) > 2.0
    assert out == b"".join(b"\xd5" * len(payload[i : i + 16]) if g else payload[i : i + 16] for i, g in zip((0, 16, 32), gone))


def test_noise_hits_the_ratio():
    tone = np.random.default_rng(1).normal(0, 0.2, 5000).astype(np.float32)
    for snr in (13.5, 3, -8):
        noise = S.noisy(tone, snr, 21).astype(np.float64) - tone
        assert abs(10 * np.log10(np.mean(tone.astype(np.float64) ** 2) / np.mean(noise**2)) - snr) < 1e-3


def test_signals_that_cannot_have_noise(spark):
    rows = [(1, [0.5, -0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [0.1, float("nan")]), (6, [0.1, None]), (None, [0.5])]
    df = spark.createDataFrame(rows, "i bigint, s array<float>")
    got = {r["i"]: (r["x"], r["why"]) for r in df.select("i", S.additive_noise(F.col("s"), F.col("i"), 10.0).alias("x"), S.noise_problem(F.col("s")).alias("why")).collect()}
    assert len(got[1][0]) == 2 and got[1][1] is None and all(got[i][0] is None and got[i][1] for i in range(2, 7)) and got[None] == (None, None)


@pytest.mark.parametrize(("rate", "target"), [(16000, 8000), (11025, 8000), (8000, 16000), (44100, 8000), (8000, 8000)])
def test_resampling_by_its_definition(spark, rate, target):
    """Together, one by one, as a table, and as a sum over all inputs of a windowed sinc."""
    rng = np.random.default_rng(9)
    signals = [rng.normal(0, 0.3, n).astype(np.float32) for n in (1, 7, 40, 333, 0)]
    common = np.gcd(rate, target)
    up, down = target // common, rate // common
    wide = max(up, down)
    kernel = lambda z: np.where(np.abs(z) <= 10, np.sinc(z) * np.i0(5 * np.sqrt(np.maximum(0, 1 - (z / 10) ** 2))) / np.i0(5.0), 0)
    scale = up / kernel(np.arange(-10 * wide, 10 * wide + 1) / wide).sum()
    together = S.resampled_rows(signals, rate, target)
    for x, y in zip(signals, together, strict=True):
        n = -(-len(x) * up // down)
        want = [(kernel((i * down - np.arange(len(x)) * up) / wide) * scale * x).sum() for i in range(n)] if up != down else x
        assert len(y) == n and np.allclose(y, want, atol=1e-6) and np.array_equal(y, S.resampled(x, rate, target))
    if up != down:
        df = spark.createDataFrame([(i, len(x), k, float(v)) for i, x in enumerate(signals) for k, v in enumerate(x)], "item int, n int, k int, x double")
        table = {(r["item"], r["i"]): r["x"] for r in S.resampled_table(df, rate, target).collect()}
        assert all(abs(table[j, i] - v) < 1e-6 for j, y in enumerate(together) for i, v in enumerate(y)) and len(table) == sum(map(len, together))


def test_normal_forms_agree(spark):
    """Texts of ASCII characters, which stay in the JVM, and others."""
    odd = ["".join(map(chr, range(128))), "a\x1cb\x1dc", " A-b_C ", "", "¿É?", "ﬁ²", None, "x\x00y", "tab\tnew\nline", "Straße №5", "a\u2028b"]
    df = spark.createDataFrame([(t,) for t in odd], "t string").select(T.normalize_text("t"))
    assert [r[0] for r in df.collect()] == [T.normalised(t) for t in odd]


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, [0.1 * (i + 1), -0.2, 0.3]) for i in range(20)], "i bigint, s array<float>")
    made = lambda n: sorted(map(str, df.repartition(n).select("i", S.additive_noise(F.col("s"), F.col("i"), 10.0).alias("x")).collect()))
    assert made(1) == made(7)


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)], "v double")
    assert tuple(df.agg(M.nearest_rank("v", 50), M.nearest_rank("v", 95)).first()) == (6.0, 11.0)
