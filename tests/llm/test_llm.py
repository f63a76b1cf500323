import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirescore.llm import bpe_reuse, decontaminate, exact_dedup, html_extract, language_id, line_dedup, simhash_dedup, substring_dedup, suffix_dedup, token_counts
from wirescore.llm.common import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, h string, n bigint"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, "a"), (4, "a"), (None, "b"), (5, "b"), (5, "b"), (6, "word " * 3000), (7, "\n\n"), (8, "a\0"), (9, "a\0\0")]


def test_exact_groups(spark):
    cut = sorted(map(str, exact_dedup.exact_duplicates(frame(spark, ODD), bucket_rows=1).collect()))
    got = sorted(map(str, exact_dedup.exact_duplicates(frame(spark, ODD)).collect()))
    by = defaultdict(list)
    for i, t in ODD:
        by[t or ""].append(i)
    assert len(got) == len(ODD) and got == cut
    kept = [r for r in exact_dedup.exact_duplicates(frame(spark, ODD).repartition(3)).collect() if r["kept"]]
    assert len(kept) == len(by) and all(r["doc_id"] == r["keep_id"] for r in kept)
    for r in exact_dedup.exact_duplicates(frame(spark, ODD)).collect():
        g = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)


def test_msd_groups_random():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 20))) * rng.choice([1, 12]) for _ in range(400)]
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[t].append(i)
    assert sorted(sorted(g) for g in exact_dedup.msd_groups(texts)) == sorted(by.values())


def test_simhash_components(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    texts = list(ODD)
    for i in range(40):
        base = [rng.choice(words) for _ in range(60)]
        texts.append((100 + 3 * i, " ".join(base)))
        base[7] = "changed"
        texts += [(101 + 3 * i, " ".join(base)), (102 + 3 * i, " ".join(base[:-1]))]
    prints = [simhash_dedup.fingerprint_of(t) for _, t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[a]] == label[a] for a in range(len(texts))):
            break
    low = defaultdict(list)
    for (i, _), x in zip(texts, label):
        if i is not None:
            low[x].append(i)
    want = sorted(str((i, f"{p:016x}", min(low[x], default=None))) for (i, _), p, x in zip(texts, prints, label))
    for rows in (4096, 3):
        got = simhash_dedup.near_duplicates(frame(spark, texts), anchor_rows=rows).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_anchors_cover():
    rng = np.random.default_rng(1)
    for _, bits in simhash_dedup.BLOCKS:
        table = simhash_dedup.anchor_offsets(bits)
        for x in rng.integers(0, 1 << bits, 50).tolist():
            home = x ^ table[simhash_dedup._syndrome(x)][0]
            for i in [None, *range(bits)]:
                y = x if i is None else x ^ (1 << i)
                assert home in {y ^ e for e in table[simhash_dedup._syndrome(y)]}


def test_tokens_as_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice("aAbÉß'sSt  \n\t.,!_09é²Ⅷσ日 ́İ") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["<|endoftext|> a", "it's we'll 'sab", "x" * 5000]
    df = frame(spark, list(enumerate(texts)))
    one, two = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in token_counts.count_tokens(df, cache_entries=50_200).collect():
        t = texts[r["doc_id"]]
        assert r["n_bytes"] == len(t.encode()) and r["n_tokens"] == len(one.encode(t, add_special_tokens=False).ids)
        assert r["over_limit"] == (r["n_tokens"] > 512)
    for r in bpe_reuse.round_trip(df, word_entries=200).collect():
        ids = two.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(two.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    odd = language_id.identify(frame(spark, [(1, None), (2, ""), (3, "12 !"), (4, "hello")])).collect()
    assert [r["lang_pred"] for r in odd][:3] == ["und"] * 3
    assert language_id.identify(frame(spark, [])).count() == 0


def brute_spans(docs, width):
    at = defaultdict(set)
    raw = [(t or "").encode() for _, t in docs]
    for i, b in enumerate(raw):
        for p in range(len(b) - width + 1):
            at[b[p : p + width]].add((i, p))
    out = []
    for (i, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if len(at[b[p : p + width]]) > 1:
                gone[p : p + width] = b"\1" * width
        runs = sum(x and not y for x, y in zip(gone, b"\0" + gone))
        out.append(str((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"crowd": 4}, {"shard_bytes": 4000}])
def test_suffix_arrays(spark, options):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    base, line = text(150), text(30)[:199]
    docs = [(0, base), (1, base), (2, base[:300] + "X" + base[301:]), (3, text(20) + base[50:280] + text(20)), (4, "a" * 450), (5, "ab" * 150), (6, None), (7, ""), (8, base[:199]), (9, "a" * 260)]
    docs += [(20 + i, text(9) + line + "0123456789"[i] + text(9)) for i in range(10)]
    got = sorted(str(tuple(r)) for r in suffix_dedup.suffix_duplicates(frame(spark, docs), **options).collect())
    assert got == brute_spans(docs, 200)


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(5)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, "a b")], "item_id bigint, text string")
    near = list(items[1])
    near[4] = near[11] = near[20] = "zzzzz"
    docs = [(1, " ".join(word() for _ in range(80))), (2, "x y " + " ".join(items[0]).upper() + " z"), (3, "q " + " ".join(near)), (4, None), (5, "")]
    for block in (32 << 20, 100):
        got = {(r["doc_id"], r["item_id"], r["n_matches"]) for r in decontaminate.contaminated(frame(spark, docs), bench, block_bytes=block).collect()}
        assert got == {(2, 0, 30), (3, 1, 27)}
    assert [r["doc_id"] for r in decontaminate.decontaminate_stage(frame(spark, docs), bench).orderBy("doc_id").collect()] == [1, 4, 5]


def test_sentences(spark):
    passage = "one two three four five six. seven eight nine ten eleven twelve thirteen."
    docs = [(1, "start of it all " + passage), (2, "another beginning. " + passage + " end"), (3, None), (4, "short. one two.")]
    rows = substring_dedup.substring_duplicates(frame(spark, docs), least_run=7).collect()
    assert [(r["doc_id"], r["keep_doc_id"]) for r in rows] and all(r["doc_id"] == 2 for r in rows)
    text = dict(docs)[2]
    assert any(text[r["start"] : r["end"]] == "seven eight nine ten eleven twelve thirteen." for r in rows)
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.cleaned(frame(spark, docs), least_run=7).collect()}
    assert clean[1] == docs[0][1] and "seven" not in clean[2] and clean[3] is None
    assert substring_dedup.substring_duplicates(frame(spark, docs)).collect() == []


def test_lines(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = [(1, long + "\nalpha beta"), (2, long + " \n\nother line here"), (3, long + "x\nAlpha, beta!"), (4, None), (5, "\n"), (6, long)]
    got = {(r["doc_id"], r["line_no"], r["keep_doc_id"]) for r in line_dedup.line_duplicates(frame(spark, docs)).collect()}
    assert got == {(2, 0, 1), (3, 1, 1), (6, 0, 1), (3, 0, 1)}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_stage(frame(spark, docs)).collect()}
    assert kept[2] == "\nother line here" and 3 not in kept and 6 not in kept and kept[5] == "\n" and kept[4] is None


def test_line_groups_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    texts = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=40)
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], rng.choice(vocabulary)]])
            texts.append(" ".join(words))
    texts += [" ".join(vocabulary[:40]), " ".join(vocabulary[39::-1])]
    docs = frame(spark, list(enumerate(texts)))
    lines = line_dedup.occurrences(docs).select("id", "doc_id").collect()
    first = {r["id"]: r["doc_id"] for r in reversed(lines)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    root = {i: i for i in first}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in itertools.combinations(sorted(first), 2):
        a, b = texts[first[x]], texts[first[y]]
        if distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
            low, high = sorted((top(x), top(y)))
            root[high] = low
    groups = {}
    for r in lines:
        groups.setdefault(top(r["id"]), set()).add(r["doc_id"])
    want = {(d, min(g)) for g in groups.values() for d in g if d != min(g)}
    assert len(want) > 10
    assert {(r["doc_id"], r["keep_doc_id"]) for r in line_dedup.line_duplicates(docs).collect()} == want


def test_edit_similarity_of_cut_lines(spark):
    pairs = [("a b c", "a b d"), ("one two", "one two three"), ("x" * 40 + " y", "x" * 40), ("p q r s t u v w", "q r s t u v w p"), ("aa " * 30 + "b", "aa " * 29 + "b"), ("é" * 20, "é" * 19 + "e")]
    rows = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(pairs)], "x long, y long, a string, b string")
    plain = "levenshtein(a, b) <= cast(floor((1 - {s}) * greatest(char_length(a), char_length(b)) + 1e-9) as int)"
    for s in (0.5, 0.8, 0.9, 0.95):
        want = {r["x"]: r["near"] for r in rows.selectExpr("x", plain.format(s=s) + " as near").collect()}
        got = {r["x"]: r["near"] for r in line_dedup.judged(rows, s).collect()}
        assert all(got.get(x, False) == near for x, near in want.items())


def test_labeller():
    net, rng = html_extract.train(), random.Random(77)
    right = total = 0
    for _ in range(60):
        page, labels = html_extract.example_page(rng)
        found = html_extract.blocks(page)
        right += int(((html_extract.label(net, [found])[0] > 0.5) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.98
    assert html_extract.main_texts(net, [None, ""]) == ["", ""]
    assert html_extract.main_texts(net, ["<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A title</h1><p>Some   text &amp; more,\nof it.</p></article><footer>&copy; x</footer>"]) == ["A title\n\nSome text & more, of it."]


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
