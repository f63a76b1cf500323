"""How corpus filters interact: what each removes, step by step, in every order they could be applied.

1. One scan gives each document a mask with a bit for each filter that it fails. Four filters look at the text alone, in
   DataFrame functions; the fifth (a copy of a document with a smaller doc_id) takes the least doc_id of each digest of a
   text, summed up in each task before the exchange, and a join on digest and doc_id, so no group of copies meets in a task.
2. The masks are counted by part, mask and labels. These cells are all that goes on: at most 4 * 2^filters rows a part,
   whatever the size of the table.
3. For each part the orders are visited by adjacent transpositions (plain changes): each order follows from the last by
   one swap of neighbours, after which only the two swapped steps are worked out anew from the cells. The Shapley sum of
   a filter grows along the walk: what it removes at its step, times the orders for which that stays so.

Edge cases. Null texts count as empty; an empty text has no words, so it fails the word count alone. A null lang is the part
''. Rows of one doc_id and text are copies of the same document: none is a copy of a smaller one. A null doc_id is neither
smaller nor greater than another, so such rows never fail as copies, nor make others fail, and have no labels. Of several
labels of a document, the greatest counts. An empty table gives no rows. Other columns are not read. Texts are equal if
their SHA-256 digests are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The last filter, which looks at other documents.
COPY = "E"
SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_filters(text: Column) -> dict[str, Column]:
    """What a text fails, by the filter's letter. Words are what stands between the six ASCII white space characters."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """Rows doc_id, part, mask: bit i is set if the document fails filter i; the copies come last."""
    text = F.coalesce("text", F.lit(""))
    filters = text_filters(text) if filters is None else filters
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())), F.lit(0))
    rows = materialise(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask")))
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = rows.join(firsts, ["digest", "doc_id"], "left")
    return marked.select("doc_id", "part", (F.col("mask") + F.when(copied, 1 << len(filters)).otherwise(0)).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """marked (doc_id, part, mask): rows part, mask, good, toxic, n."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return marked.join(known, "doc_id", "left").select("part", "mask", *flags).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def plain_changes(n: int) -> Iterator[int]:
    """The places k of the swaps (k, k + 1) that lead through all n! orders, each seen once."""
    order, way = list(range(n)), [-1] * n
    while True:
        mobile = [x for i, x in enumerate(order) if 0 <= i + way[x] < n and order[i + way[x]] < x]
        if not mobile:
            return
        most = max(mobile)
        at = order.index(most)
        to = at + way[most]
        order[at], order[to] = order[to], order[at]
        for x in range(most + 1, n):
            way[x] = -way[x]
        yield min(at, to)


def walk(counts: np.ndarray, letters: str) -> pd.DataFrame:
    """counts[mask] = documents, good ones, toxic ones of one part: a row for each order and step."""
    n = len(letters)
    mask = np.arange(1 << n)
    total = int(counts[:, 0].sum())
    fails = [int(counts[mask >> f & 1 == 1, 0].sum()) for f in range(n)]
    alone = [int(counts[1 << f, 0]) for f in range(n)]
    order, steps = list(range(n)), [np.zeros(3, np.int64)] * n
    shapley, since, seen, rows = [0] * n, [0] * n, 0, []

    def step(k: int) -> np.ndarray:
        """What the filter at place k removes of what those before it keep."""
        before = sum(1 << f for f in order[:k])
        return counts[(mask >> order[k] & 1 == 1) & (mask & before == 0)].sum(0)

    def settle(k: int) -> None:
        """Credit the filter at place k with the orders since its step last changed."""
        shapley[order[k]] += int(steps[k][0]) * (seen - since[order[k]])
        since[order[k]] = seen

    def report() -> None:
        kept, name = total, "".join(letters[f] for f in order)
        for k, (f, (removed, good, toxic)) in enumerate(zip(order, steps, strict=True)):
            kept -= int(removed)
            rows.append((name, k + 1, kept, int(removed), fails[f] - int(removed), alone[f], int(good), int(toxic), f))

    for k in range(n):
        steps[k] = step(k)
    report()
    seen = 1
    for k in plain_changes(n):
        settle(k)
        settle(k + 1)
        order[k], order[k + 1] = order[k + 1], order[k]
        steps[k], steps[k + 1] = step(k), step(k + 1)
        report()
        seen += 1
    for k in range(n):
        settle(k)
    out = pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "filter"])
    out["shapley"] = out.pop("filter").map(dict(enumerate(shapley)))
    return out


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """counted (part, mask, good, toxic, n): every order of the filters, in each part. letters has a filter for each bit."""

    def audit(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(letters), 3), np.int64)
        for i, worth in enumerate((1, part.good, part.toxic)):
            np.add.at(counts[:, i], part["mask"].to_numpy(), (part.n * worth).to_numpy(np.int64))
        return walk(counts, letters).assign(part=part.part.iloc[0])[SCHEMA.replace(",", "").split(" ")[::2]]

    return counted.groupBy("part").applyInPandas(audit, SCHEMA)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, zeros included."""
    return interactions(cells(masks(docs), labels), "ABCD" + COPY)


#: Every part, order and step from the same cells, in plain SQL.
ORACLE_SQL = r"""
    WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    failed AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
                      + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
                      + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 4 ELSE 0 END)
                      + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
                      + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS m FROM words),
    known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
              FROM labels GROUP BY doc_id),
    cells AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
              FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, m),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM f a, f b, f d, f e, f g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
    bits AS (SELECT o, step, substr(o, step, 1) AS c, 1 << (ascii(substr(o, step, 1)) - 65) AS bit,
                    coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(substr(o, 1, step - 1), '') IF x <> '']), 0)::BIGINT AS before
             FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    steps AS (SELECT part, o, step, c,
                     sum(CASE WHEN m & before = 0 AND m & bit = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM cells, bits GROUP BY part, o, step, c)
    SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM steps"""
