"""Filter interactions against loops over documents and orders."""

import re
from itertools import permutations

import pytest

from wirescore.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(210))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG + " #", "en"), (4, "A B " * 150, "en"), (5, "A B " * 150, "de"), (5, "A B " * 150, "de"),
    (6, None, None), (7, "", None), (8, "", ""), (9, "SHOUT & more", "de"), (None, LONG, "en"), (None, LONG, "en"), (10, "x y z\x0bq", "ru"),
    (11, "w " * 5000, "ru"), (12, LONG.upper(), "ru"), (0, LONG, "ru"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (5, 1, None), (5, None, 1), (9, None, None), (None, 1, 1), (99, 1, 1)]


def fails(doc, docs):
    doc_id, text, _ = doc
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    found = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs),
    }
    return {f for f, bad in found.items() if bad}


def brute(docs, labels):
    out = {}
    for part in {d[2] or "" for d in docs}:
        rows = [(fails(d, docs), d[0]) for d in docs if (d[2] or "") == part]
        has = lambda i, place: any(x[0] == i and i is not None and x[place] == 1 for x in labels)
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                all_f = sum(f in r[0] for r in rows)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), all_f - len(gone), sum(r[0] == {f} for r in rows), sum(has(r[1], 1) for r in gone), sum(has(r[1], 2) for r in gone),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def test_against_loops(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").selectExpr("*", "'x' as mask", "1 as part", "'y' as digest", "true as good")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'z' as text", "'q' as lang")
    got = filter_audit.filter_interactions(docs, labels).collect()
    want = brute(DOCS, LABELS)
    assert len(got) == len(want) == 600 * 4
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(docs.limit(0), labels).count() == 0
    rows = filter_audit.filter_interactions(docs, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0")
    assert rows.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_plain_changes_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in filter_audit.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))
    assert sum(1 for _ in filter_audit.plain_changes(n)) == len(seen) - 1
