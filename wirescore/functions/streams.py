"""Random streams as columns: seed sequences and PCG64 in whole numbers, so that loss needs no Python worker.

The numbers are those of numpy's default generator. 32-bit words are longs; a word times a constant goes through halves of
the constant, which stay below 2^48. The 128-bit state of the generator is eight limbs of 16 bits, lowest first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the seed sequence and of the generator.
INIT_A, MULT_A, INIT_B, MULT_B, MIX_L, MIX_R = 0x43B0D7E5, 0x931E8875, 0x8B51F9DD, 0x58F38DED, 0xCA01F9DD, 0x4973F715
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
WORD, LIMB = 0xFFFFFFFF, 0xFFFF
POOL, LIMBS = 4, 8


def limbs(value: int) -> list[int]:
    return [value >> 16 * k & LIMB for k in range(LIMBS)]


def hash_constants(first: int, factor: int, n: int) -> list[tuple[int, int]]:
    """What the n-th hashing step takes: the constant before and after it has moved on."""
    found, now = [], first
    for _ in range(n):
        found.append((now, now := now * factor & WORD))
    return found


def pool_steps() -> list[tuple[int, int, int, int]]:
    """(source, target, constants) of the steps that stir each word of the pool into all others."""
    moves = [(i, j) for i in range(POOL) for j in range(POOL) if i != j]
    return [(i, j, *c) for (i, j), c in zip(moves, hash_constants(INIT_A, MULT_A, POOL + len(moves))[POOL:], strict=True)]


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _times(word: Column, factor: Column) -> Column:
    high = F.shiftleft((word * F.shiftright(factor, 16)).bitwiseAND(F.lit(LIMB)), 16)
    return (high + word * factor.bitwiseAND(F.lit(LIMB))).bitwiseAND(F.lit(WORD))


def _fold(word: Column) -> Column:
    return _let(word, lambda w: w.bitwiseXOR(F.shiftright(w, 16)))


def _hashed(word: Column, before: Column, after: Column) -> Column:
    return _fold(_times(word.bitwiseXOR(before), after))


def _table(rows: list[tuple[int, ...]], *names: str) -> Column:
    """An array of structs of whole numbers."""
    return F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])


def _words(value: Column) -> Column:
    """The 32-bit words of a number that is not negative, lowest first, as few as it needs."""
    value = value.cast("bigint")
    low, high = value.bitwiseAND(F.lit(WORD)), F.shiftright(value, 32)
    return F.when(high == 0, F.array(low)).otherwise(F.array(low, high))


def seed_words(numbers: list[Column], n: int) -> Column:
    """n 32-bit words of the seed sequence of up to four words of numbers, none of them negative."""
    entropy = F.concat(*[_words(x) for x in numbers])
    start = _table([(i, *c) for i, c in enumerate(hash_constants(INIT_A, MULT_A, POOL))], "i", "before", "after")
    end = _table([(i % POOL, *c) for i, c in enumerate(hash_constants(INIT_B, MULT_B, n))], "i", "before", "after")
    zero, left, right = F.lit(0).cast("bigint"), F.lit(MIX_L), F.lit(MIX_R)
    at = lambda a, k: F.get(a, k.cast("int"))
    pool = F.transform(start, lambda s: _hashed(F.coalesce(at(entropy, s["i"]), zero), s["before"], s["after"]))

    def stir(pool: Column, step: Column) -> Column:
        other = _times(_hashed(at(pool, step["i"]), step["before"], step["after"]), right)
        mixed = _fold((_times(at(pool, step["j"]), left) - other).bitwiseAND(F.lit(WORD)))
        return F.transform(pool, lambda word, k: F.when(k == step["j"], mixed).otherwise(word))

    pool = F.aggregate(_table(pool_steps(), "i", "j", "before", "after"), pool, stir)
    return _let(pool, lambda p: F.transform(end, lambda s: _hashed(at(p, s["i"]), s["before"], s["after"])))


def _step(state: Column, inc: Column) -> Column:
    """state * MULTIPLIER + inc, modulo 2^128, limb by limb with a carry."""
    factors = F.array(*[F.lit(x).cast("bigint") for x in limbs(MULTIPLIER)])
    zero = F.lit(0).cast("bigint")

    def limb(acc: Column, k: Column) -> Column:
        total = acc["carry"] + inc[k] + F.aggregate(F.sequence(F.lit(0), k), zero, lambda t, i: t + state[i] * factors[k - i])
        return _let(total, lambda r: F.struct(F.shiftright(r, 16).alias("carry"), F.concat(acc["limbs"], F.array(r.bitwiseAND(F.lit(LIMB)))).alias("limbs")))

    start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("limbs"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(LIMBS)]), start, limb)["limbs"]


def _added(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")

    def limb(acc: Column, k: Column) -> Column:
        return _let(acc["carry"] + a[k] + b[k], lambda r: F.struct(F.shiftright(r, 16).alias("carry"), F.concat(acc["limbs"], F.array(r.bitwiseAND(F.lit(LIMB)))).alias("limbs")))

    start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("limbs"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(LIMBS)]), start, limb)["limbs"]


def _output(state: Column) -> Column:
    """53 bits of the state as a double from 0 up to 1: its halves folded and turned by its highest six bits."""
    half = lambda at: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(state[at + k], 16 * k) for k in range(4)])
    turn = F.shiftright(state[7], 10).cast("int")
    turned = _let(half(0).bitwiseXOR(half(4)), lambda x: F.call_function("shiftrightunsigned", x, turn).bitwiseOR(F.call_function("shiftleft", x, (64 - turn) % 64)))
    return F.shiftrightunsigned(turned, 11).cast("double") * 2.0**-53


def uniforms(seed: Column, n: Column) -> Column:
    """The first n doubles from 0 up to 1 of the generator with that seed (below 2^64), as an array."""
    words = seed_words([seed], 16 // 2)
    # Words of 32 bits make numbers of 64, lowest word first, and these the state and the stream, highest number first.
    pieces = lambda w, order: F.array(*[F.shiftright(w[k], s).bitwiseAND(F.lit(LIMB)) for k in order for s in (0, 16)])
    twice = lambda a: F.array(*[F.shiftleft(a[k], 1).bitwiseOR(F.shiftright(a[k - 1], 15) if k else F.lit(1).cast("bigint")).bitwiseAND(F.lit(LIMB)) for k in range(LIMBS)])

    def run(w: Column) -> Column:
        return _let(F.struct(pieces(w, (2, 3, 0, 1)).alias("state"), twice(pieces(w, (6, 7, 4, 5))).alias("inc")), from_start)

    def from_start(s: Column) -> Column:
        # The stream's first state is inc, to which the seed's state is added before the first step.
        first = _step(_added(s["inc"], s["state"]), s["inc"])

        def draw(acc: Column, _: Column) -> Column:
            return _let(_step(acc["state"], s["inc"]), lambda new: F.struct(new.alias("state"), F.concat(acc["out"], F.array(_output(new))).alias("out")))

        start = F.struct(first.alias("state"), F.array().cast("array<double>").alias("out"))
        count = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(count, start, draw)["out"]

    return _let(words, run)


def lost_frames(item: Column, n: Column, loss_rate: float, run: int = 0) -> Column:
    """Which of the n frames of an item packet loss takes, as an array of booleans: the same as functions.signal.lost()."""
    seed = seed_words([F.lit(run), item], 1)[0]
    return F.transform(uniforms(seed, n), lambda u: u < loss_rate)


def without_lost(codes: Column, item: Column, silence: int, loss_rate: float, size: int, run: int = 0) -> Column:
    """codes (array<int>, a byte each) with frames of `size` replaced by silence where they are lost."""
    n = F.ceil(F.size(codes) / F.lit(float(size))).cast("int")
    return _let(lost_frames(item, n, loss_rate, run), lambda gone: F.transform(codes, lambda c, i: F.when(F.get(gone, (i / size).cast("int")), silence).otherwise(c)))
