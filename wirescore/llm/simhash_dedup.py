"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most 4. They are cut into three blocks of
21, 21 and 22 bits; of two that link, one block at least differs in at most one bit. In each
block the anchors are the words of a covering code: the perfect [15, 11] Hamming code on the
block's first 15 bits, and every value of the bits that remain. Its covering radius is 1, so each
fingerprint has one home anchor within 1, and it is replicated to every anchor within radius
plus threshold, 2. Two blocks that differ in at most one bit then meet at the home of either.
Candidates are compared anchor by anchor on all 64 bits.

Equal fingerprints are one node. An anchor with more than `anchor_rows` fingerprints is cut into
tiles, each pair of tiles a task of its own, so no link is lost and no task holds more than two
tiles. From each anchor only a spanning forest of its links leaves the task, never all pairs.

Edge cases. Null texts count as empty; texts without a word have fingerprint zero and link like
any other. Words are cut at ASCII white space, and only A-Z are lower-cased. Repeated rows share
fingerprint and component. component_id is null only if no doc_id of the component is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices
from .components import connected_components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: (first bit, bits) of the blocks; the first 15 bits of each are covered by the Hamming code.
BLOCKS = ((0, 21), (21, 21), (42, 22))
HAMMING = 15


# ---- fingerprints


def shingle_hashes(text: str | bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the folded text, in order."""
    from xxhash import xxh64_intdigest

    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - width].tolist()
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprint_of(text: str | bytes | None) -> int:
    return majority(shingle_hashes(text))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed bigint."""

    @F.arrow_udf(returnType="bigint")
    def prints(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary()).to_pylist()
        out = np.zeros(len(raw), np.uint64)
        for a, b in slices([len(t or b"") for t in raw], 1 << 20):
            parts = [shingle_hashes(t) for t in raw[a:b]]
            sizes = np.array([len(p) for p in parts])
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            if len(full) == 1:
                out[a + full[0]] = majority(parts[full[0]])
                continue
            bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ends = np.cumsum(sizes[full])
            sums = np.add.reduceat(bits, np.r_[0, ends[:-1]], axis=0, dtype=np.int32)
            flags = np.packbits(2 * sums > sizes[full][:, None], axis=1, bitorder="little")
            out[a + full] = np.ascontiguousarray(flags).view(np.uint64).ravel()
        return pa.array(out.view(np.int64))

    return prints(text)


# ---- anchors


def _syndrome(block: int) -> int:
    """The Hamming syndrome of a block's first 15 bits: the xor of the positions of its ones."""
    s = 0
    for i in range(HAMMING):
        if block >> i & 1:
            s ^= i + 1
    return s


def anchor_offsets(bits: int) -> list[list[int]]:
    """For each syndrome, the differences from a block to the anchors within 2, the home first."""
    single = [1 << i for i in range(bits)]
    near = [0, *single, *(a | b for k, a in enumerate(single) for b in single[:k])]
    by: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for e in near:
        by[_syndrome(e)].append(e)
    for s, found in enumerate(by):
        home = 1 << (s - 1) if s else 0
        found.remove(home)
        found.insert(0, home)
    return by


def replicas(prints: DataFrame) -> DataFrame:
    """prints (v bigint, distinct) at every anchor: rows k (block and anchor), v, home."""
    made = []
    for n, (first, bits) in enumerate(BLOCKS):
        block = F.shiftrightunsigned("v", first).bitwiseAND(F.lit((1 << bits) - 1))
        syndrome = F.lit(0)
        for j in range(4):
            mask = sum(1 << i for i in range(HAMMING) if (i + 1) >> j & 1)
            syndrome = syndrome + (F.bit_count(block.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
        table = F.array(*[F.array(*[F.lit(e) for e in row]) for row in anchor_offsets(bits)])
        where = F.posexplode(F.element_at(table, (syndrome + 1).cast("int")))
        made.append(
            prints.select("v", block.alias("b"), where).select((F.col("b").bitwiseXOR(F.col("col")) + F.lit(n << 32)).alias("k"), "v", (F.col("pos") == 0).alias("home"))
        )
    return made[0].union(made[1]).union(made[2])


# ---- comparison


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(keys: np.ndarray, prints: np.ndarray, home: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of equal keys (keys are sorted)."""
    n = len(keys)
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    left = np.repeat(np.r_[edge[1:], n], np.diff(np.r_[edge, n])) - np.arange(n)
    at, found = np.flatnonzero(left > 1), []
    step = 1
    while len(at):
        to = at + step
        hit = (home[at] | home[to]) & (np.bitwise_count(prints[at] ^ prints[to]) <= most)
        if hit.any():
            found.append((at[hit], to[hit]))
            if sum(len(x) for x, _ in found) > 2_000_000:
                label = forest(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                moved = np.flatnonzero(label != np.arange(n))
                found = [(moved, label[moved])]
        step += 1
        at = at[left[at] > step]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = forest(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by k; runs of one k are compared when they are complete."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def edges(k, v, h) -> pa.RecordBatch:
        a, b = links(k, v.view(np.uint64), h)
        return pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], names=["a", "b"])

    for batch in batches:
        part = tuple(np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("k", "v", "home"))
        if not len(part[0]):
            continue
        held.append(part)
        rows += len(part[0])
        if rows < 60_000:
            continue
        k, v, h = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield edges(k[:cut], v[:cut], h[:cut])
        held, rows = [(k[cut:], v[cut:], h[cut:])], len(k) - cut
    if rows:
        yield edges(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(prints: DataFrame, anchor_rows: int = 4096) -> DataFrame:
    """prints (v bigint, distinct): rows a, b whose connected components are those of the links."""
    spread = replicas(prints)
    crowded = materialise(spread.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > anchor_rows))
    plain = spread.join(crowded.select("k"), "k", "left_anti")
    out = plain.repartition("k").sortWithinPartitions("k").mapInArrow(_compare, "a bigint, b bigint")
    if not crowded.isEmpty():
        tiles = F.ceil(F.col("n") / anchor_rows).cast("bigint")
        own = F.pmod(F.xxhash64("v"), tiles)
        tiled = spread.join(crowded, "k").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)))
        tiled = tiled.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "v", "home")
        out = out.union(tiled.repartition("k").sortWithinPartitions("k").mapInArrow(_compare, "a bigint, b bigint"))
    return out


# ---- the operator


def _components(marked: DataFrame, anchor_rows: int) -> DataFrame:
    """marked (doc_id, v): rows v, root, component_id, one for each fingerprint."""
    prints = materialise(marked.groupBy("v").agg(F.min("doc_id").alias("rep")))
    found = connected_components(fingerprint_links(prints.select("v"), anchor_rows), "a", "b")
    rooted = prints.join(found.select(F.col("node").alias("v"), "root"), "v", "left").select("v", "rep", F.coalesce("root", "v").alias("root"))
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = materialise(rooted.join(low, "root").select("v", "root", "component_id"))
    discard(prints)
    return of


def near_duplicates(docs: DataFrame, anchor_rows: int = 4096) -> DataFrame:
    """Rows doc_id, fingerprint (16 hex digits), component_id: one for each row of docs."""
    marked = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fingerprint(F.col("text")).alias("v")))
    of = _components(marked, anchor_rows).drop("root")
    return marked.join(of, "v").select("doc_id", F.lower(F.lpad(F.hex("v"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(docs: DataFrame, anchor_rows: int = 4096) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without one last, and of several
    with that doc_id the one whose text has the smallest hash. Rows with the same doc_id and text are
    one document, of which one row stays. All columns as they came, whatever their names."""
    names = docs.columns
    identity = [F.col("doc_id").isNull().alias("k0"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")]
    marked = materialise(docs.select(*identity, F.col("doc_id").cast("bigint").alias("doc_id"), fingerprint(F.col("text")).alias("v")))
    of = _components(marked, anchor_rows).select("v", "root")
    kept = marked.join(of, "v").groupBy("root").agg(F.min(F.struct("k0", "k1", "k2")).alias("keep")).select("keep.*")
    # Repeated rows meet before the exchange already, so a row repeated very often is no hot key.
    rows = docs.select(*identity, F.struct(*[F.col(f"`{c}`") for c in names]).alias("r")).groupBy("k0", "k1", "k2").agg(F.first("r").alias("r"))
    return rows.join(kept, ["k0", "k1", "k2"], "left_semi").select(*[F.col(f"r.`{c}`").alias(c) for c in names])
