"""Array functions for sampled audio: gain, companding, framing, noise, loss and jitter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of G.711: sample bounds, bias and segment ends of each law, silence bytes.
MU_CLIP, MU_BIAS = 32635, 132
MU_ENDS = (0xFF, 0x1FF, 0x3FF, 0x7FF, 0xFFF, 0x1FFF, 0x3FFF, 0x7FFF)
A_ENDS = (0x1F, 0x3F, 0x7F, 0xFF, 0x1FF, 0x3FF, 0x7FF, 0xFFF)
SILENCE = {"pcmu": 0xFF, "pcma": 0xD5}
TELEPHONE_RATE = 8000


def gain_and_clip(samples: Column, gain_db: float = 0.0, clip: float | None = None) -> Column:
    factor = 10 ** (gain_db / 20)

    def one(x: Column) -> Column:
        y = x.cast("double") * F.lit(factor)
        return (y if clip is None else F.least(F.greatest(y, F.lit(-clip)), F.lit(clip))).cast("float")

    return F.transform(samples, one)


def pcm16(samples: Column) -> Column:
    """Clip to [-1, 1], scale by 32768, round half to even, and clip to 16 bits."""
    return F.transform(samples, lambda x: F.least(F.greatest(F.rint(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32768), F.lit(-32768.0)), F.lit(32767.0)).cast("int"))


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _segment(magnitude: Column, ends: tuple[int, ...]) -> Column:
    return sum((F.when(magnitude > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))


def mu_law(pcm: Column) -> Column:
    def one(x: Column) -> Column:
        def coded(m: Column) -> Column:
            s = _segment(m, MU_ENDS)
            # The mantissa is the four bits below the leading one of the segment.
            low = F.expr("0")
            for k in range(8):
                low = F.when(s == k, F.shiftright(m, k + 3).bitwiseAND(F.lit(15))).otherwise(low)
            sign = F.when(x < 0, 0x7F).otherwise(0xFF)
            return (s * 16 + low).bitwiseXOR(sign)

        # The law takes 14 bits: negative samples round away from zero.
        return _bind(F.least(4 * F.abs(F.shiftright(x, 2)), F.lit(MU_CLIP)) + MU_BIAS, coded)

    return F.transform(pcm, one)


def mu_law_decode(codes: Column) -> Column:
    table = []
    for code in range(256):
        u = ~code & 0xFF
        value = (((u & 15) << 3) + MU_BIAS << (u >> 4 & 7)) - MU_BIAS
        table.append((-value if u & 0x80 else value) / 32768)
    lookup = F.array(*[F.lit(float(np.float32(v))) for v in table])
    return F.transform(codes, lambda c: F.element_at(lookup, c + 1).cast("float"))


def frames(samples: Column, size: int) -> Column:
    """Frames of so many samples; the last may be shorter."""
    starts = F.when(F.size(samples) > 0, F.sequence(F.lit(1), F.size(samples), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(samples, at, F.lit(size)))


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples))


def stream_seed(run: int, item: int, *stream: int) -> int:
    """The first 32-bit word of the seed sequence of an item's random stream."""
    return int(np.random.SeedSequence([run, item, *stream]).generate_state(1)[0])


def noisy(samples: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    signal = np.asarray(samples, np.float64)
    power = np.sqrt(np.mean(signal**2))
    if not power:
        raise ValueError("a silent signal has no signal-to-noise ratio")
    noise = np.random.default_rng(seed).standard_normal(len(signal))
    return (signal + noise * (power / 10 ** (snr_db / 20) / np.sqrt(np.mean(noise**2)))).astype(np.float32)


def additive_noise(samples: Column, item: Column, snr_db: float, run: int = 0) -> Column:
    """Gaussian noise scaled to the ratio; its stream depends on run and item alone. Null where there is no such noise: for a
    null, empty, silent or not finite signal (see noise_problem) or a null item."""

    @F.pandas_udf("array<float>")
    def add(values: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or pd.isna(i) else noisy(v, snr_db, stream_seed(run, int(i), 1)) for v, i in zip(values, items)])

    fit = noise_problem(samples).isNull() & item.isNotNull()
    return F.when(fit, add(F.when(fit, samples), F.when(fit, item)))


def noise_problem(samples: Column) -> Column:
    """Why a signal cannot have noise at a ratio to its own power; null if it can."""
    return (
        F.when(samples.isNull(), "there is no signal")
        .when(F.size(samples) == 0, "the signal is empty")
        .when(F.exists(samples, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "the signal is not finite")
        .when(~F.exists(samples, lambda x: x != 0), "a silent signal has no signal-to-noise ratio")
    )


def lost(payload: bytes, codec: str, loss_rate: float, frame_ms: int = 20, seed: int = 0) -> bytes:
    """Frames of a G.711 payload replaced by silence, each with the given probability."""
    size = frame_ms * TELEPHONE_RATE // 1000
    if not payload or not loss_rate:
        return payload
    gone = np.random.default_rng(seed).random(-(-len(payload) // size)) < loss_rate
    data = np.frombuffer(payload, np.uint8).copy()
    data[np.repeat(gone, size)[: len(data)]] = SILENCE[codec]
    return data.tobytes()


def late(payload: bytes, codec: str, jitter_std_ms: float, buffer_ms: float, frame_ms: int = 20, seed: int = 0) -> bytes:
    """Frames whose normal delay exceeds the playout buffer, replaced by silence."""
    size = frame_ms * TELEPHONE_RATE // 1000
    if not payload or not jitter_std_ms:
        return payload
    gone = np.random.default_rng(seed).normal(0, jitter_std_ms, -(-len(payload) // size)) > buffer_ms
    data = np.frombuffer(payload, np.uint8).copy()
    data[np.repeat(gone, size)[: len(data)]] = SILENCE[codec]
    return data.tobytes()


def packet_loss(payload: Column, item: Column, codec: str, loss_rate: float, frame_ms: int = 20, run: int = 0) -> Column:
    @F.pandas_udf("binary")
    def drop(values: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([lost(bytes(v), codec, loss_rate, frame_ms, stream_seed(run, int(i))) for v, i in zip(values, items)])

    return drop(payload, item)


def jitter_loss(payload: Column, item: Column, codec: str, jitter_std_ms: float, buffer_ms: float, frame_ms: int = 20, run: int = 0) -> Column:
    @F.pandas_udf("binary")
    def drop(values: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([late(bytes(v), codec, jitter_std_ms, buffer_ms, frame_ms, stream_seed(run, int(i), 2)) for v, i in zip(values, items)])

    return drop(payload, item)


def lossy_channel(rows: DataFrame, item: str, codes: str, codec: str, loss_rate: float, jitter_std_ms: float, buffer_ms: float, frame_ms: int = 20, run: int = 0) -> DataFrame:
    """rows (item bigint, codes array<int>): item and payload, after packet loss and then late
    frames, in one pass through Python."""

    def through(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, v in zip(part[item], part[codes]):
                kept = lost(bytes(np.asarray(v, np.uint8)), codec, loss_rate, frame_ms, stream_seed(run, int(i)))
                out.append(late(kept, codec, jitter_std_ms, buffer_ms, frame_ms, stream_seed(run, int(i), 2)))
            yield pd.DataFrame({item: part[item], "payload": out})

    return rows.select(item, codes).mapInPandas(through, f"{item} bigint, payload binary")


def a_law(pcm: Column) -> Column:
    def one(x: Column) -> Column:
        def coded(m: Column) -> Column:
            s = _segment(m, A_ENDS)
            low = F.call_function("shiftright", m, F.greatest(s, F.lit(1))).bitwiseAND(F.lit(15))
            return (s * 16 + low).bitwiseXOR(F.when(x < 0, 0x55).otherwise(0xD5))

        return _bind(F.when(x < 0, -F.shiftright(x, 3) - 1).otherwise(F.shiftright(x, 3)), coded)

    return F.transform(pcm, one)


def a_law_decode(codes: Column) -> Column:
    table = []
    for code in range(256):
        segment, low = (code ^ 0x55) >> 4 & 7, (code ^ 0x55) & 15
        # The middle of the code's step; steps double from the second segment on.
        value = (2 * low + 1) * 8 if segment == 0 else (2 * low + 33) * 8 << (segment - 1)
        table.append((value if code & 0x80 else -value) / 32768)
    lookup = F.array(*[F.lit(float(np.float32(v))) for v in table])
    return F.transform(codes, lambda c: F.element_at(lookup, c + 1).cast("float"))


def taps(rate: int, target: int) -> tuple[int, int, np.ndarray]:
    """(up, down, h): a row of h for each of the `up` places that an output may have between two inputs, with what it takes of
    the inputs around it: a Kaiser-windowed (beta 5) low pass of 10 zero crossings a side, summing to `up`."""
    common = np.gcd(rate, target)
    up, down = int(target // common), int(rate // common)
    half = 10 * max(up, down)
    at = np.arange(-half, half + 1) / max(up, down)
    low_pass = np.sinc(at) * np.kaiser(2 * half + 1, 5.0)
    low_pass *= up / low_pass.sum()
    reach = half // up + 1
    tap = half + np.arange(up)[:, None] - np.arange(-reach, reach + 1) * up
    return up, down, np.where((tap >= 0) & (tap <= 2 * half), low_pass[np.clip(tap, 0, 2 * half)], 0.0)


def tap_table(spark: SparkSession, rate: int, target: int) -> DataFrame:
    """Rows o, tap: output n is the sum over inputs k of tap * input[k] where o = n * down - k * up."""
    up, down, h = taps(rate, target)
    reach = h.shape[1] // 2
    rows = [(p - (j - reach) * up, float(h[p, j])) for p in range(up) for j in range(2 * reach + 1) if h[p, j]]
    return spark.createDataFrame(rows, "o bigint, tap double")


def resampled_table(samples: DataFrame, rate: int, target: int, by: str = "item") -> DataFrame:
    """samples (by, n: samples of the signal, k: place from 0, x): rows by, i, x at the target rate, by a join of each sample's
    outputs with the table of taps, and a sum. No signal meets in one task, however long; the table has as many rows as taps."""
    up, down, _ = taps(rate, target)
    half = 10 * max(up, down)
    first, last = f"greatest(0, cast(ceil((k * {up} - {half}) / {down}) as bigint))", f"least(cast(ceil(n * {up} / {down}) as bigint) - 1, cast(floor((k * {up} + {half}) / {down}) as bigint))"
    reached = samples.where(f"{first} <= {last}").select(by, "k", "x", F.explode(F.expr(f"sequence({first}, {last})")).alias("i")).withColumn("o", F.col("i") * down - F.col("k") * up)
    met = reached.join(F.broadcast(tap_table(samples.sparkSession, rate, target)), "o")
    return met.groupBy(by, "i").agg(F.sum(F.col("x").cast("double") * F.col("tap")).alias("x"))


#: Outputs that are summed at once.
BLOCK = 1 << 14


def resampled_rows(rows: list[np.ndarray], rate: int, target: int) -> list[np.ndarray]:
    """Each signal at the target rate: ceil(n * target / rate) samples, zeros beyond its ends, sums in double precision. The
    signals of one rate lie end to end with a filter's reach of zeros between, so that blocks of windows of all of them
    are multiplied with the taps of their places at once."""
    if rate == target or not rows:
        return [np.asarray(x, np.float32) for x in rows]
    up, down, h = taps(rate, target)
    reach = h.shape[1] // 2
    sizes = np.array([len(x) for x in rows])
    begin = np.cumsum(sizes + reach) - sizes
    line = np.zeros(int(begin[-1] + sizes[-1] + reach + 1))
    for x, at in zip(rows, begin, strict=True):
        line[at : at + len(x)] = x
    counts = -(-sizes * up // down)
    n = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    centre, phase = np.repeat(begin, counts) + n * down // up, n * down % up
    windows = np.lib.stride_tricks.sliding_window_view(line, 2 * reach + 1)
    out = np.empty(len(n), np.float32)
    for a in range(0, len(n), BLOCK):
        seen = windows[centre[a : a + BLOCK] - reach]
        out[a : a + BLOCK] = seen @ h[0] if up == 1 else np.einsum("nj,nj->n", seen, h[phase[a : a + BLOCK]])
    return np.split(out, np.cumsum(counts)[:-1])


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    return resampled_rows([np.asarray(samples, np.float64)], rate, target)[0]


def resample(samples: Column, rate: Column, target: int) -> Column:
    """Null for a null signal or rate. The rows of a batch that have one rate are resampled together."""

    @F.pandas_udf("array<float>")
    def convert(values: pd.Series, rates: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        known = [i for i, (v, r) in enumerate(zip(values, rates)) if v is not None and not pd.isna(r)]
        for one in {int(rates.iloc[i]) for i in known}:
            which = [i for i in known if rates.iloc[i] == one]
            for i, x in zip(which, resampled_rows([values.iloc[i] for i in which], one, target), strict=True):
                out[i] = x
        return pd.Series(out)

    return convert(samples, rate)
