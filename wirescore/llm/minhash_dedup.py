"""Near duplicates by MinHash: many universal hash minima, bands, verification, connected components.

1. One scan makes the set of a text (64-bit hashes of its distinct word shingles), a bitmap of the set, and 240 minima of it,
   each under a function of the multiply-shift family x -> (a * x + b mod 2^64) >> 32, folded into 40 bands of six. Equal sets
   are one class from here on, summed up in each task before the exchange, so thousands of copies are one row.
2. Classes that agree on a band are candidates. Two sets with a similarity of 0.85 agree on some band but for 6 in 10^9,
   for they agree on each with 0.85^6. First each class of a band is held against one of them, the pivot: the one that
   meets most others over all bands, so a large group of near copies costs each class a pair or two. The groups of what is similar are then found, and only bands
   that still hold several groups go on. There, classes of different groups are candidates, the largest group never with
   itself, if their bitmaps allow the similarity: each bit that differs is a shingle that only one of them has, so the
   bound is exact, and of two million such pairs of a crowded table a few thousand are left.
3. Candidates are verified by their minima (the share of equal ones estimates the similarity; 0.70 or less is ruled out, which a
   similar pair falls to with 3 in 10^8), and what is left is confirmed on the full sets, made again from the texts.
4. Connected groups by alternating large-star and small-star; each has the least doc_id of its documents.

Edge cases. Null and empty texts, and texts of white space, have no set: they are linked with nothing and are kept. Texts
with fewer words than a shingle have one shingle, the whole sequence. A null doc_id counts as the greatest: it is a
component_id only where all documents of the group have none, and those are then all kept. Rows of one doc_id are separate
documents; all of them are kept if it is the component's. Very long texts are read whole; their bitmaps end at 2^14 bits,
beyond which the bound rules out less and step 3 does the rest. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from .common import discard, materialise
from .components import connected_components

WORDS, PERCENT = 3, 85
BANDS, ROWS = 40, 6
MINIMA = BANDS * ROWS
#: A pair goes on to its full sets if more of its minima than this agree.
LEAST_EQUAL = int(0.70 * MINIMA)
#: Bits of a bitmap for each shingle, up to a power of two; most bits of one.
BITS, MOST_BITS = 8, 1 << 14
#: Shingles that are hashed at once.
BLOCK = 1 << 15

_random = np.random.default_rng(12)
_A, _B = (_random.integers(0, 1 << 64, MINIMA, np.uint64, endpoint=False) for _ in range(2))
_A |= np.uint64(1)
#: Odd factors of the words of a shingle, and of the minima of a band.
_WORD, _ROW = (_random.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1) for n in (64, ROWS))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, each worked out once while it is remembered."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, known: Words, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z as a-z. bytes.split() cuts at
    the six ASCII white space characters, and bytes.lower() changes A-Z alone."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _WORD[i]
    return np.unique(_mix(total))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MINIMA minima for each set, none of which is empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = np.concatenate(sets)
    return np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(_A, _B, strict=True)], 1) >> np.uint64(32)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A row of BANDS keys of 64 bits; keys of different bands differ."""
    bands = (mins.reshape(len(mins), BANDS, ROWS) * _ROW).sum(2, dtype=np.uint64)
    return _mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _WORD[0]).view(np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """The hashes of a set modulo a power of two, as bits in words of 64. Halves of a bitmap, one laid over the other, are the
    set's bitmap of half the bits."""
    bits = np.zeros(min(MOST_BITS, max(64, 1 << (BITS * len(found) - 1).bit_length())), np.uint8)
    bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _words_of(n: str) -> str:
    """How many words of 64 bits the bitmap of a set of n has, in SQL."""
    return f"cast(least({MOST_BITS // 64}, greatest(1, pow(2, ceil(log2({BITS} * {n})) - 6))) as int)"


def _blocks(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, s in enumerate(sets):
        if i > at and total + len(s) > BLOCK:
            yield at, i
            at, total = i, 0
        total += len(s)
    if at < len(sets):
        yield at, len(sets)


def sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                sets = [shingle_set(t, known, words) for t in batch.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, marks, digests, maps = ([None] * len(sets) for _ in range(4))
                for a, b in _blocks([sets[i] for i in full]):
                    mins = minima([sets[i] for i in full[a:b]])
                    for i, k, m in zip(full[a:b], band_keys(mins), mins.astype(np.uint16), strict=True):
                        keys[i], marks[i], digests[i], maps[i] = k, m.tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes()), bitmap(sets[i])
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), sizes, pa.array(digests, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, maps)), pa.array(marks, pa.binary())],
                    names=["doc_id", "row", "n", "digest", "keys", "bits", "marks"],
                )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and row name a text, for rows of one doc_id may differ."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows doc_id, row, n (size of the set), digest, keys, bits and marks of each document; what follows n is null without a set."""
    return _rows(docs).mapInArrow(sign(words), f"doc_id {_kind(docs)}, row bigint, n bigint, digest binary, keys array<bigint>, bits array<bigint>, marks binary")


def classes_of(rows: DataFrame) -> DataFrame:
    """One numbered row for each distinct set: id, digest, low (least doc_id), n, keys, bits, marks, and doc_id and row of a text that has it."""
    one = F.min(F.struct("doc_id", "row"))
    grouped = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), one.alias("one"), *[F.first(c).alias(c) for c in ("n", "keys", "bits", "marks")])
    return grouped.select(F.monotonically_increasing_id().alias("id"), "digest", "low", "n", "keys", "bits", "marks", "one.doc_id", "one.row")


def shared_bands(classes: DataFrame) -> DataFrame:
    """Rows k, id, p of the bands that several classes have. p is the pivot: of the classes of the band, the one that meets most
    others over all its bands. Of a group of copies with edits of their own, that is what they were copied from, or near it."""
    spread = classes.select(F.explode("keys").alias("k"), "id")
    sizes = spread.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    shared = materialise(spread.join(sizes, "k"))
    met = shared.groupBy("id").agg(F.sum("m").alias("met"))
    pivots = shared.join(met, "id").groupBy("k").agg(F.max(F.struct("met", "id"))["id"].alias("p"))
    return shared.select("k", "id").join(pivots, "k")


def still_apart(bands: DataFrame, groups: DataFrame) -> DataFrame:
    """bands (k, id, p): the rows k, id, c (group), most (the group of most classes) of bands of several groups."""
    marked = bands.join(groups.select(F.col("node").alias("id"), "root"), "id", "left").select("k", "id", F.coalesce("root", "id").alias("c"))
    sizes = marked.groupBy("k", "c").agg(F.count("*").alias("size"))
    split = sizes.groupBy("k").agg(F.max_by("c", F.struct("size", "c")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    return marked.join(split.drop("groups"), "k")


def strays(apart: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows x, y: each class outside the largest group of its band beside those of all other groups of the band, if sizes
    and bitmaps allow the similarity. A class has its bitmap in its own length and in that of the smallest set that
    can be similar to it, so that two such classes have some length in common."""
    lengths = F.expr(f"array_distinct(array({_words_of('n')}, {_words_of(f'ceil(n * {percent} / 100)')}))")
    maps = classes.select("id", "n", "bits", F.explode(lengths).alias("w"))
    half = "zip_with(slice(bits, 1, w), slice(bits, w + 1, w), (u, v) -> u | v)"
    maps = maps.select("id", "n", "w", F.size("bits").alias("own"), F.expr(f"if(size(bits) = w, bits, {half})").alias("bits"))
    rows = apart.join(maps, "id")
    one = rows.where("c <> most").select("k", "w", "most", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("own").alias("ox"), F.col("bits").alias("bx"))
    other = rows.select("k", "w", F.col("id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("own").alias("oy"), F.col("bits").alias("by"))
    differ = "aggregate(zip_with(bx, by, (u, v) -> bit_count(u ^ v)), 0, (s, d) -> s + d)"
    fit = f"""cx <> cy and (cy = most or x < y) and w = least(ox, oy) and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)
              and 100 * (nx + ny - {differ}) >= {percent} * (nx + ny + {differ})"""
    met = one.join(other, ["k", "w"]).where(fit)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


@F.pandas_udf(IntegerType())
def equal_minima(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(1))


def by_minima(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose sizes and minima allow the similarity."""
    one, other = (classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("marks").alias(f"m{c}")) for c in "xy")
    met = pairs.join(one, "x").join(other, "y").where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    return met.where(equal_minima("mx", "my") > LEAST_EQUAL).select("x", "y")


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, words: int, broadcast_ids: int) -> DataFrame:
    """Rows id, found: the full sets of the classes, as bytes, from the texts that stand for them. Where the texts are is
    broadcast up to a count of classes, at some 30 bytes each; beyond, the join is shuffled."""
    wanted = classes.join(ids, "id").select("id", F.col("doc_id").alias("d"), F.col("row").alias("r"))
    wanted = materialise(wanted)
    texts = _rows(docs).join(F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted, F.col("row").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingle_set(t, known, words).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "found"])

    # A row that is there several times stands for its class once.
    return texts.select("id", "text").mapInArrow(full, "id bigint, found binary").groupBy("id").agg(F.first("found").alias("found"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose full sets (id, found) are similar enough."""

    @F.pandas_udf(BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p: bytes, q: bytes) -> bool:
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)], dtype=bool)

    one, other = (sets.select(F.col("id").alias(c), F.col("found").alias(f"s{c}")) for c in "xy")
    return pairs.join(one, "x").join(other, "y").where(similar("sx", "sy")).select("x", "y")


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, broadcast_ids: int) -> DataFrame:
    """The pairs (x, y) that are similar, as a written table."""
    close = materialise(by_minima(pairs, classes, percent))
    ids = close.select(F.col("x").alias("id")).union(close.select("y")).distinct()
    sets = materialise(sets_of(ids, classes, docs, words, broadcast_ids))
    out = materialise(confirmed(close, sets, percent))
    discard(close)
    discard(sets)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept, one for each document. The bands are made for a percent of 85; higher ones are
    found as surely, lower ones less so."""
    rows = materialise(signed(docs, words))
    classes = materialise(classes_of(rows))
    bands = materialise(shared_bands(classes))
    first = bands.where("id <> p").select(F.col("p").alias("x"), F.col("id").alias("y")).distinct()
    near = links(first, classes, docs, words, percent, broadcast_ids)
    groups = connected_components(near, "x", "y")
    more = links(strays(still_apart(bands, groups), classes, percent), classes, docs, words, percent, broadcast_ids)
    discard(bands)
    if not more.isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("x"), F.col("root").alias("y")).union(more), "x", "y")
    of = classes.select("id", "digest", "low").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "root").select("digest", "component_id")
    met = rows.where("n > 0").select("doc_id", "n", "digest").join(of, "digest").select("doc_id", "n", "component_id")
    out = met.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs that share a shingle, which only a small table allows.
ORACLE_SQL = r"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^ 	-
]+') AS w FROM documents),
    grams AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS g FROM words),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS MATERIALIZED (SELECT x, y FROM met JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 85 * (s.n + t.n - common)),
    edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
    lows AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lows USING (doc_id)"""
