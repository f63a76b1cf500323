"""Compression of vectors to one byte a part, with codebooks by Elkan's form of Lloyd's algorithm, exact in integers.

1. Components become integers floor(1024 * x) in DataFrame functions; vectors are cut into equal consecutive parts. The
   codebooks start as the parts of the vectors of smallest vec_id: a bounded number of rows, so the driver holds them.
2. Each round is one pass over a written table, without a shuffle of vectors. A row carries, for each part, its entry, an
   upper bound of the distance to it, and one lower bound for each entry of the codebook (a byte each, rounded down
   against a step of the row's own). In the next round the lower bounds fall and the upper bound grows by how far the
   entries moved. A part is left alone if its upper bound is below half the way from its entry to the nearest other one;
   else an entry is looked at only if neither its lower bound nor half its distance from the part's entry is above the
   upper bound. All of these are strict: what could be a tie is decided by squared distances in integers, ties to the
   lower index. The first round has no bounds and looks at all entries.
3. A task adds up its parts by entry and writes the sums beside its rows, so a round needs no second pass; the sums of all
   tasks are added in Spark, and the driver gets at most parts * entries rows of them.
4. After the last round parts are assigned once more, and errors are summed by label in Spark.

Edge cases. Vectors that are null or hold null, NaN or infinite components are dropped. With fewer vectors than entries the
codebooks are shorter. Rows of one vec_id are separate vectors, the smaller components first; a null vec_id comes after all others.
All vectors are meant to have the length of the first. One of another length, of a length that cannot be cut into equal
parts, or with a component so great that an error might not fit a long (beyond 185,000 for 64 components) stays with null
code and error, and has no part in the codebooks. A sum of errors that does not fit is null. An empty table gives no rows.
Other columns are not read; equal labels are summed together, nulls too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose candidate entries are worked out at once in a task.
BLOCK = 1024
#: Slack of float bounds against rounding, far above what a few additions lose.
UP, DOWN = 1 + 1e-9, 1 - 1e-9
#: Products of components up to here are exact in doubles, so that a matrix product can be used.
EXACT = 1 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """Rows vec_id, label, ints: vectors without null or non-finite components, as integers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(F.col("embedding").isNotNull() & ~bad).select("vec_id", "label", ints.alias("ints"))


def greatest(width: int) -> int:
    """Largest component for which the squared distances of all parts of that width sum to a long."""
    return math.isqrt(2**63 // (4 * PARTS * max(1, width))) - 1


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact, as int64."""
    if not x.size or max(np.abs(x).max(), np.abs(entries).max()) <= EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


class Codebook:
    """The entries of one part, with what the pruning needs: how far they moved and how far they are apart."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.moved = None if before is None else np.sqrt(((entries - before) ** 2).sum(1)) * UP
        self.half = np.sqrt(_distances(entries, entries)) / 2 * DOWN
        self.nearest = np.where(np.eye(len(entries), dtype=bool), np.inf, self.half).min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entry, its squared distance, upper and lower bounds for parts that have no bounds yet."""
        apart = _distances(x, self.entries)
        code = apart.argmin(1)
        best = apart[np.arange(len(x)), code]
        return code, best, np.sqrt(best) * UP, np.sqrt(apart) * DOWN

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the bounds of the last round, which held for the entries before they moved."""
        upper, lower = upper + self.moved[code], np.maximum(lower - self.moved, 0)
        code, best = code.copy(), np.full(len(x), -1, np.int64)
        live = np.flatnonzero(upper >= self.nearest[code])
        own = code[live]
        best[live] = ((x[live] - self.entries[own]) ** 2).sum(1)
        upper[live] = np.sqrt(best[live]) * UP
        lower[live, own] = np.sqrt(best[live]) * DOWN
        open_ = (lower[live] <= upper[live, None]) & (self.half[own] <= upper[live, None])
        open_[np.arange(len(live)), own] = False
        i, j = np.nonzero(open_)
        apart = ((x[live[i]] - self.entries[j]) ** 2).sum(1)
        lower[live[i], j] = np.sqrt(apart) * DOWN
        # The own entry stands beside the others that are left; the least of (distance, index) is the nearest.
        rows, entries, apart = np.concatenate([live[i], live]), np.concatenate([j, own]), np.concatenate([apart, best[live]])
        order = np.lexsort((entries, apart, rows))
        at, least = np.unique(rows[order], return_index=True)
        code[at], best[at] = entries[order][least], apart[order][least]
        upper[at] = np.sqrt(best[at]) * UP
        return code, best, upper, lower


def _state(kinds: T.StructType) -> T.StructType:
    fields = [("code", T.BinaryType()), ("upper", T.BinaryType()), ("step", T.BinaryType()), ("lower", T.BinaryType()), ("error", T.LongType())]
    return T.StructType([*(kinds[c] for c in ("vec_id", "label", "ints")), *(T.StructField(n, t) for n, t in fields)])


SUMS = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("entry", T.IntegerType()), ("n", T.LongType()), ("sums", T.ArrayType(T.LongType())))])


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary column with one value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // len(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, PARTS, -1)


def _assign(books: list[Codebook], schema: pa.Schema, last: bool):
    """The function of a round over batches: rows with new entries and bounds, then the task's sums."""
    width = books[0].entries.shape[1]

    def block(ints: np.ndarray, old: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
        found = []
        for p, book in enumerate(books):
            x = ints[:, p * width : (p + 1) * width]
            if old is None:
                code, best, upper, lower = book.first(x)
            else:
                code, best, upper, lower = book.again(x, old[0][:, p, 0].astype(np.int64), old[1][:, p, 0], old[3][:, p] * old[2][:, p].astype(np.float64))
            if last and (unknown := np.flatnonzero(best < 0)).size:
                best[unknown] = ((x[unknown] - book.entries[code[unknown]]) ** 2).sum(1)
            step = np.maximum(lower.max(1), 1e-30).astype(np.float32)[:, None] / np.float32(255)
            found.append((code.astype(np.uint8), upper, step, np.minimum(lower / step.astype(np.float64), 255).astype(np.uint8), best))
        return tuple(np.stack(c, 1) for c in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, len(books[0].entries), width), np.int64), np.zeros((PARTS, len(books[0].entries)), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n, names = batch.num_rows, batch.schema.names
                ints = batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, PARTS * width)
                old = None
                if "lower" in names:
                    old = tuple(_matrix(batch.column(c), kind, n) for c, kind in (("code", np.uint8), ("upper", np.float64), ("step", np.float32), ("lower", np.uint8)))
                code, upper, step, lower, best = block(ints, old)
                for p in range(PARTS):
                    counts[p] += np.bincount(code[:, p], minlength=counts.shape[1])
                    np.add.at(sums[p], code[:, p], ints[:, p * width : (p + 1) * width])
                made = {"code": _bytes(code), "error": pa.array(best.sum(1)) if last else pa.nulls(n, pa.int64())}
                if not last:
                    made |= {"upper": _bytes(upper), "step": _bytes(step), "lower": _bytes(lower)}
                made |= {c: batch.column(c) for c in ("vec_id", "label", "ints")}
                yield _batch(schema, made, n, 0)
        if not last:
            part, entry = np.nonzero(counts)
            made = {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(counts[part, entry]), "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))}
            if len(part):
                yield _batch(schema, made, len(part), 1)

    return run


def _batch(schema: pa.Schema, columns: dict[str, pa.Array], n: int, kind: int) -> pa.RecordBatch:
    columns = columns | {"kind": pa.array(np.full(n, kind, np.int32))}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _round(rows: DataFrame, books: list[Codebook], last: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with their new entries, and the sums by part and entry, of one written pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    state = _state(rows.schema)
    both = T.StructType([*state.fields, *SUMS.fields, T.StructField("kind", T.IntegerType())])
    written = materialise(rows.mapInArrow(_assign(books, to_arrow_schema(both), last), both), by="kind")
    return written, written.where("kind = 0").select(*state.names), written.where("kind = 1").select(*SUMS.names)


def _moved(books: list[Codebook], sums: DataFrame) -> list[Codebook]:
    """The next codebooks: floor(sum / count) of the parts of each entry; unused entries stay."""
    width = books[0].entries.shape[1]
    added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    new = [b.entries.copy() for b in books]
    for row in added.collect():
        new[row.part][row.entry] = [s // row.n for s in row.sums]
    return [Codebook(n, b.entries) for n, b in zip(new, books, strict=True)]


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.entries.ravel()).encode()).hexdigest()


def _order() -> list[Column]:
    return [F.col("vec_id").asc_nulls_last(), F.size("ints"), F.col("ints")]


def trained(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """kept (vec_id, label, ints): rows vec_id, label, code, error, one for each, and the codebooks."""
    lead = kept.orderBy(*_order()).select(F.size("ints").alias("n")).first()
    length = lead.n if lead else 0
    width = length // PARTS
    fits = F.lit(length % PARTS == 0) & (F.size("ints") == length) & ~F.exists("ints", lambda x: F.abs(x) > greatest(width))
    rows = kept.where(fits).select("vec_id", "label", F.col("ints").cast("array<int>").alias("ints"))
    starts = [r.ints for r in rows.orderBy(*_order()).select("ints").limit(entries).collect()]
    others = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not starts:
        return others, []
    starts = np.array(starts, np.int64).reshape(len(starts), PARTS, width)
    books, old = [Codebook(starts[:, p]) for p in range(PARTS)], None
    for k in range(rounds + 1):
        table, rows, sums = _round(rows, books, last=k == rounds)
        if k < rounds:
            books = _moved(books, sums)
        discard(old)
        old = table
    return rows.select("vec_id", "label", "code", "error").union(others), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Rows vec_id, code, error, label_error, codebooks_sha256 of the vectors kept."""
    rows, books = trained(usable(vectors))
    totals = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    met = rows.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same by plain Lloyd rounds over all entries, which only a small table allows."""
    ctes = [
        "kept AS (SELECT vec_id, label, [CAST(floor(x * 1024) AS BIGINT) FOR x IN embedding] AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, p, CAST(v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS DOUBLE[]) AS x FROM kept, range(4) t(p))",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256)",
        "b0 AS MATERIALIZED (SELECT p, e, x AS c FROM firsts JOIN parts USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, p, min(s).e AS e, min(s).d AS d FROM (SELECT vec_id, parts.p, {{'d': CAST(list_inner_product(x, x) "
            f"- 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT), 'e': e}} AS s FROM parts JOIN b{k} ON parts.p = b{k}.p) GROUP BY vec_id, p)"
        )
        if k < ROUNDS:
            ctes.append(
                f"m{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS DOUBLE) AS m "
                f"FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN parts USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e)"
            )
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))")
    ctes.append(f"book AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN c], ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS})")
    ctes.append(f"coded AS (SELECT vec_id, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return "WITH " + ",\n".join(ctes) + (
        "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 "
        "FROM coded JOIN kept USING (vec_id), book"
    )
