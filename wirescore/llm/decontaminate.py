"""Benchmark decontamination by spaced seeds.

Texts become words: ASCII letters are lower-cased, and runs of ASCII letters, digits and bytes of
other characters are words. A seed is a fixed mask over consecutive words; words under a 0 are
ignored, so a substituted word does not hide a match from every mask. The seed hashes of the
benchmark, sorted, are joined in each map task with those of the documents, all positions of all
documents. Around each hit the document and the item are laid side by side, and the best run
(a match counts 1, a substitution -4, so a run has at least four matches in five) is kept: an
overlap is reported from `least_matches` matching words on, or from all words of a shorter item.

The benchmark goes to the tasks in blocks of at most `block_bytes`; however large it grows, the
documents are read against one bounded block after another.

Edge cases. Null and empty texts match nothing, nor do items of fewer words than the shortest
mask. An item that occurs several times in a document gives its best overlap, the earliest of
equal ones. Repeated rows of documents and repeated items each give their own rows, merged where
they are equal. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Six words of a span of nine or ten each: fixed masks that differ in what they ignore.
MASKS = ("111111", "1101100111", "1011011011", "1110011011")
MISMATCH = -4

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:
    have = cache.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = cache[int(base)] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """Hashes of the words of some texts, one after another, and where each text's begin."""

    hashes: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Each text is followed by one separator, so no word crosses two texts."""
    raw = _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = _WORD[raw]
    change = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    starts, ends = change[::2], change[1::2]
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)]
        hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    return Words(hashes, np.searchsorted(starts, begins))


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at every position at which the mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(mask):
            if m == "1":
                out = out * _BASE + hashes[i : i + n]
    return mix(out ^ np.uint64(hash_of_mask(mask)))


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64)


class Benchmark:
    """Items and their sorted seed hashes."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.words = ids, words_of(texts)
        found, at, item = [], [], []
        for mask in MASKS:
            h = seeds(self.words.hashes, mask)
            owner = np.searchsorted(self.words.first, np.arange(len(h)), side="right") - 1
            whole = np.arange(len(h)) + len(mask) <= self.words.first[owner + 1]
            found.append(h[whole])
            at.append(np.flatnonzero(whole))
            item.append(owner[whole])
        self.seeds = np.concatenate(found)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.at, self.item = self.seeds[order], np.concatenate(at)[order], np.concatenate(item)[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, words: Words) -> list[tuple[int, int, int]]:
        """Distinct (text, item, diagonal): word position in the text less that in the item."""
        out: list[np.ndarray] = []
        for mask in MASKS:
            h = seeds(words.hashes, mask)
            some = np.flatnonzero(self.sieve[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            low = np.searchsorted(self.seeds, h[some])
            high = np.searchsorted(self.seeds, h[some], side="right")
            reps = high - low
            if not reps.sum():
                continue
            pos = np.repeat(some, reps)
            hit = np.repeat(low - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            owner = np.searchsorted(words.first, pos, side="right") - 1
            whole = pos + len(mask) <= words.first[owner + 1]
            item = self.item[hit]
            diagonal = (pos - words.first[owner]) - (self.at[hit] - self.words.first[item])
            out.append(np.stack([owner, item, diagonal], 1)[whole])
        return [] if not out else [tuple(x) for x in np.unique(np.concatenate(out), axis=0).tolist()]


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """The best run on a diagonal: (matches, first word in doc, words). Earliest of equal ones."""
    a, b = max(0, diagonal), min(len(doc), len(item) + diagonal)
    best, total, start, matches = (0, 0, 0), 0, a, 0
    top = 0
    for i, same in enumerate((doc[a:b] == item[a - diagonal : b - diagonal]).tolist(), a):
        if total < 0:
            total, start, matches = 0, i, 0
        total += 1 if same else MISMATCH
        matches += same
        if total > top:
            top, best = total, (matches, start, i + 1 - start)
    return best


#: In a worker: the last block of items and its index.
_BUILT: list[tuple[tuple, "Benchmark"]] = []


def _index(shared) -> "Benchmark":
    """The index of a broadcast block of items, made once a worker rather than once a task."""
    block = shared.value
    if not _BUILT or _BUILT[0][0] is not block:
        _BUILT[:] = [(block, Benchmark(*block))]
    return _BUILT[0][1]


def _overlaps(bench: Benchmark, texts: list[bytes], least: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item): (matches, less the first word, words) of the best overlap of each pair that has one."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in slices([len(t) for t in texts], 1 << 20):
        words = words_of(texts[a:b])
        for text, item, diagonal in bench.hits(words):
            doc = words.hashes[words.first[text] : words.first[text + 1]]
            own = bench.words.hashes[bench.words.first[item] : bench.words.first[item + 1]]
            matches, start, n = overlap(doc, own, diagonal)
            if matches >= min(least, len(own)):
                best[a + text, item] = max(best.get((a + text, item), (0, 0, 0)), (matches, -start, n))
    return best


def _search(batches: Iterator[pa.RecordBatch], bench: Benchmark, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        best = _overlaps(bench, [t or b"" for t in batch.column("t").to_pylist()], least)
        rows = [(ids[text], bench.ids[item], -start, n, m) for (text, item), (m, start, n) in best.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "doc_word", "n_words", "n_matches"])


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator:
    """Broadcasts of (ids, texts): the items in blocks of about block_bytes of text, by a hash of the text."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    blocks = -(-total // block_bytes) or 1
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == n).orderBy("item_id", "t").collect()
        if block or not n:
            yield benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in block], [bytes(r["t"]) for r in block]))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_matches: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Rows doc_id, item_id, doc_word (first word of the overlap in the document), n_words,
    n_matches, similarity: the best overlap of each document and item that have one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t")).where("t is not null")
    out = None
    for shared in item_blocks(benchmark, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], shared=shared, least=least_matches) -> Iterator[pa.RecordBatch]:
            yield from _search(batches, _index(shared), least)

        found = rows.mapInArrow(search, "doc_id bigint, item_id bigint, doc_word bigint, n_words bigint, n_matches bigint")
        out = found if out is None else out.union(found)
    return out.withColumn("similarity", F.col("n_matches") / F.col("n_words"))


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, least_matches: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the documents that overlap a benchmark item, judged row by row; all columns as they
    came, whatever their names. Documents without a doc_id are judged like any other; null texts stay."""
    for shared in item_blocks(benchmark, block_bytes):
        docs = docs.where(~_leaks(shared, least_matches)(F.col("text").cast("binary")))
    return docs


def _leaks(shared, least: int):
    """An Arrow UDF of texts: whether one overlaps an item of a block."""

    @F.arrow_udf(returnType="boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        found = {text for text, _ in _overlaps(_index(shared), [t or b"" for t in texts.to_pylist()], least)}
        return pa.array([i in found for i in range(len(texts))], pa.bool_())

    return leaks
