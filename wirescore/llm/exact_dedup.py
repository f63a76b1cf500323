"""Exact duplicates by distributed MSD radix partitioning.

Texts are byte strings, and equality is decided by the bytes alone; no digest takes part.

1. Each map task splits its own rows by successive bytes, batch by batch, and writes one numbered row for
   each distinct text, with the members it stands for. Only the text, the count and the largest
   member go on, so a text that a third of all rows share is a few small rows from here on.
2. The leading bytes deal the rows out. A lead that too many rows share is split further by the
   following bytes, level by level, for as long as a level splits anything: the counts are
   partially aggregated sums, and only leads over the bound go on. The number of such leads is
   bounded by rows / `bucket_rows`, and they meet the rows in an ordinary join whose strategy
   the optimizer picks by size.
3. Each reduce task takes its leads in order and goes on splitting by successive bytes until every
   group is a single text or has ended; it holds no more than the buckets at hand.
4. What was found joins the members by the number of their row, so no task holds a group's members.

Edge cases. A null text counts as empty. Of equal texts the row with the largest doc_id stays; a
null doc_id ranks below every other. Rows with the same doc_id and text are separate members of
the group, and exactly one row of each group has kept = true. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes that each level of the distributed part adds to the lead.
WIDTHS = (16, 128, 1024, 8192, 65536)


def msd_groups(texts: list[bytes]) -> list[list[int]]:
    """Indexes of equal texts, by splitting on 8 successive bytes at a time. A group is done
    when one text is left in it or when its texts have ended."""
    done: list[list[int]] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(len(texts)), 0)]
    while stack:
        rows, at = stack.pop()
        if len(rows) == 1:
            done.append(rows.tolist())
            continue
        # A short digit is padded with zeros; the number of bytes left tells it from real zeros.
        digit = np.frombuffer(b"".join(texts[i][at : at + 8].ljust(8, b"\0") for i in rows), dtype=">u8").astype(np.uint64)
        left = np.fromiter((min(8, max(0, len(texts[i]) - at)) for i in rows), np.uint8, len(rows))
        order = np.lexsort((left, digit))
        digit, left, rows = digit[order], left[order], rows[order]
        new = np.flatnonzero((digit[1:] != digit[:-1]) | (left[1:] != left[:-1])) + 1
        for part, n in zip(np.split(rows, new), left[np.r_[0, new]]):
            if n < 8:
                done.append(part.tolist())
            elif len(part) > 1 and at >= 64 and len(part) <= 8:
                done.extend(_compared(texts, part.tolist()))
            else:
                stack.append((part, at + 8))
    return done


def _compared(texts: list[bytes], rows: list[int]) -> list[list[int]]:
    """The end of the recursion for a handful of rows: the remaining bytes in one comparison."""
    groups: list[list[int]] = []
    for i in rows:
        for g in groups:
            if texts[g[0]] == texts[i]:
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a batch: its number k, the text, its members, and the largest of them."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts, ids = _texts(batch.column("t")), batch.column("i").to_pylist()
        groups = msd_groups(texts)
        members = [[ids[i] for i in g] for g in groups]
        best = [max((i for i in g if i is not None), default=None) for g in members]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(number, number + len(groups)), pa.int64()), pa.array([texts[g[0]] for g in groups], pa.binary()), pa.array(members, pa.list_(pa.int64())), pa.array(best, pa.int64())], names=["k", "t", "members", "best"]
        )
        number += len(groups)


#: Bytes of text that are settled together, once their buckets are complete.
SETTLED = 4 << 20


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lead, k, t, n, best in order of lead: what each row k belongs to. Only the buckets that are not yet
    complete, or not yet many enough, are held."""
    held: list[tuple] = []
    size = 0

    def groups(rows: list[tuple]) -> pa.RecordBatch:
        texts, out = [r[2] for r in rows], []
        for g in msd_groups(texts):
            # Largest id first, then the smallest number: the row that holds the member that stays.
            top = max(g, key=lambda i: (rows[i][4] is not None, rows[i][4] or 0, -rows[i][1]))
            n, digest = sum(rows[i][3] for i in g), hashlib.sha256(texts[g[0]]).hexdigest()
            out += [(rows[i][1], rows[top][4], n, rows[i][1] == rows[top][1], digest) for i in g]
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["k", "keep_id", "group_size", "holds", "text_sha256"])

    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("lead", "k", "t", "n", "best"))))
        held += rows
        size += sum(len(r[2]) for r in rows)
        if size < SETTLED or not held:
            continue
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        if cut:
            yield groups(held[:cut])
            held = held[cut:]
            size = sum(len(r[2]) for r in held)
    if held:
        yield groups(held)


def exact_duplicates(docs: DataFrame, bucket_rows: int = 4096) -> DataFrame:
    """Rows doc_id, keep_id, group_size, kept, text_sha256: one for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("i"), F.col("text").cast("binary").alias("t"))
    # Written once, so that the numbers of its rows hold.
    distinct = materialise(rows.mapInArrow(_collapse, "k bigint, t binary, members array<bigint>, best bigint"))
    dealt = _deal(distinct.select("k", "t", F.size("members").alias("n"), "best"), bucket_rows)
    settled = dealt.mapInArrow(_settle, "k bigint, keep_id bigint, group_size bigint, holds boolean, text_sha256 string")
    met = distinct.select("k", "members").join(settled, "k").select("*", F.posexplode("members").alias("at", "doc_id"))
    first = F.when(F.col("keep_id").isNull(), 0).otherwise(F.array_position("members", F.col("keep_id")) - 1)
    return met.select("doc_id", "keep_id", "group_size", (F.col("holds") & (F.col("at") == first)).alias("kept"), "text_sha256")


def _deal(distinct: DataFrame, bucket_rows: int) -> DataFrame:
    """distinct (k, t, n, best), dealt out by leading bytes in order of lead, with crowded leads split by the bytes that
    follow. Copies within a map task's batch are one row here, so they make no lead crowded."""
    lead, crowded = F.substring("t", 1, WIDTHS[0]), []
    seen = distinct.select("t")
    at = WIDTHS[0]
    for width in WIDTHS[1:]:
        level = seen.where(F.octet_length("t") > at).groupBy(F.substring("t", 1, at).alias("lead")).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
        level = materialise(level.select("lead"))
        if level.isEmpty():
            break
        crowded.append((at, level))
        seen = seen.join(level, F.substring("t", 1, at) == level["lead"], "left_semi")
        at += width
    dealt = distinct.withColumn("lead", lead)
    for (at, level), width in zip(crowded, WIDTHS[1:]):
        mark = level.select("lead", F.lit(True).alias("crowded"))
        dealt = dealt.join(mark, "lead", "left").withColumn("lead", F.when(F.col("crowded"), F.substring("t", 1, at + width)).otherwise(F.col("lead"))).drop("crowded")
    return dealt.repartition(F.col("lead")).sortWithinPartitions("lead").select("lead", "k", "t", "n", "best")
