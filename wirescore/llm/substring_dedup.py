"""Substring deduplication by hashing lines and the sentences in them.

A unit is a sentence: lines are cut after sentence ends, and a longer stretch without one also
after words whose hash says so, so a passage that is repeated in the middle of other text falls
into the same units wherever it stands. Units are normalised (lower case, words only, one space
between them) and digested with 128 bits. Digests are grouped over all documents; the occurrence
of lowest rank (doc_id, then row, then offset) stays, and every other one is reported with its
offsets in the original text.

Sentences of fewer than `least_words` words are not unlikely to be equal by chance. Those that follow
each other in a line are joined, and cut again after words whose hash says so. What is still shorter
is digested together with its neighbours in the line, so it counts as repeated where they are
repeated with it; a line that is one unit counts whole. So every word of a repeated line belongs to a
repeated unit.

A short unit says little by itself: most documents share a sentence with another by chance. Units are
removed in runs: of neighbouring units that are all repeated, with `least_run` words together at least.
Shorter runs stay; repeated lines however short are the business of the line operator.

Edge cases. Null and empty texts and lines without a word have no units. Text without spaces has few
words, so its lines are mostly found as a whole only. Rows with the same doc_id and text are one
document. A null doc_id ranks first. Offsets count code points from 0; `end` is exclusive. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices

_SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\s|$)|[.!?]+|\n|$)")
_WORD = re.compile(r"\w+")
#: A stretch of more words than this is cut after words whose hash divides by CUT.
LONG = 24
CUT = 8
#: The same for joined short sentences, which are cut after one of them.
SHORT_CUT = 2

UNITS = "doc_id bigint, row bigint, no int, start int, end int, n_words int, d1 bigint, d2 bigint"


def units(text: str, least_words: int = 5) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit."""
    out: list[tuple[int, int, int, bytes]] = []
    line: list[tuple[int, int, list[str]]] = []
    low = text.lower()
    plain = len(low) == len(text)
    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        part = low[a:b] if plain else text[a:b].lower()
        words = _WORD.findall(part)
        if words:
            line.append((a + len(part) - len(part.lstrip()), a + len(text[a:b].rstrip()), words))
        if text[b - 1] == "\n":
            out += _digests(_cut(text, line, least_words), least_words)
            line = []
    return out + _digests(_cut(text, line, least_words), least_words)


def _last(word: str, cut: int) -> bool:
    return crc32(word.encode("utf-8", "surrogatepass")) % cut == 0


def _cut(text: str, sentences: list[tuple[int, int, list[str]]], least_words: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the pieces of a line: every word is in one."""
    out: list[tuple[int, int, list[str]]] = []
    held: list[str] = []
    start = end = 0
    for a, b, words in sentences:
        if len(words) < least_words:
            start, end = (start if held else a), b
            held = held + words
            if len(held) >= least_words and (len(held) > LONG or _last(held[-1], SHORT_CUT)):
                out.append((start, end, held))
                held = []
            continue
        if held:
            out.append((start, end, held))
            held = []
        if len(words) <= LONG:
            out.append((a, b, words))
            continue
        for w in _WORD.finditer(text, a, b):
            start = start if held else w.start()
            held.append(w.group().lower())
            if len(held) >= least_words and _last(held[-1], CUT):
                out.append((start, w.end(), held))
                held = []
        if held:
            out.append((start, b, held))
            held = []
    return out + [(start, end, held)] if held else out


def _digests(pieces: list[tuple[int, int, list[str]]], least_words: int) -> list[tuple[int, int, int, bytes]]:
    from xxhash import xxh3_128_digest

    out = []
    for i, (start, end, words) in enumerate(pieces):
        said = " ".join(words)
        if len(words) < least_words and len(pieces) > 1:
            near = [" ".join(pieces[j][2]) if 0 <= j < len(pieces) else "" for j in (i - 1, i + 1)]
            said = "\0".join([near[0], said, near[1]])
        out.append((start, end, len(words), xxh3_128_digest(said.encode("utf-8", "surrogatepass"))))
    return out


def _units(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in UNITS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        ids, rows, texts = (batch.column(i).to_pylist() for i in range(3))
        for a, b in slices([len(t or "") for t in texts], 1 << 20):
            cols: list[list] = [[] for _ in names]
            for i in range(a, b):
                for no, (start, end, n, digest) in enumerate(units(texts[i] or "", least_words)):
                    d1, d2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    for c, v in zip(cols, (ids[i], rows[i], no, start, end, n, d1, d2)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def units_of(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """Rows doc_id, row, start, end, n_words, d1, d2: the units of all documents."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    return rows.mapInArrow(lambda batches: _units(batches, least_words), UNITS)


def repeated_spans(docs: DataFrame, least_words: int = 5, least_run: int = 24) -> DataFrame:
    """Rows doc_id, row, start, end, n_words, keep_doc_id, keep_start: each removed unit."""
    every = materialise(units_of(docs, least_words))
    rank = F.struct("doc_id", "row", "start")
    groups = every.groupBy("d1", "d2").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "keep")
    later = every.join(groups, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("keep")))
    # Neighbours have one difference of number and rank. Rows that are one document have each unit several times.
    doc = Window.partitionBy("doc_id", "row")
    runs = later.withColumn("run", F.col("no") - F.dense_rank().over(doc.orderBy("no")))
    words = F.sum("n_words").over(Window.partitionBy("doc_id", "row", "run")) / F.count("*").over(Window.partitionBy("doc_id", "row", "run", "no"))
    long = runs.withColumn("words", words).where(F.col("words") >= least_run)
    return long.select("doc_id", "row", "start", "end", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"))


def substring_duplicates(docs: DataFrame, least_words: int = 5, least_run: int = 24) -> DataFrame:
    """Rows doc_id, start, end, n_words, keep_doc_id, keep_start: each removed unit."""
    return repeated_spans(docs, least_words, least_run).drop("row")


def cleaned(docs: DataFrame, least_words: int = 5, least_run: int = 24) -> DataFrame:
    """Rows doc_id, text without the removed units, removed (array of start, end)."""
    spans = repeated_spans(docs, least_words, least_run).groupBy(F.col("doc_id").alias("g"), F.col("row").alias("h")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    met = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("row") == F.col("h")), "left")
    kept = F.aggregate(
        "removed",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return met.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce("removed", empty).alias("removed"))
