from wirescore.llm import substring_dedup


def digests(text):
    return {d: (a, b) for a, b, _, d in substring_dedup.units(text)}


def test_every_word_of_a_line_is_in_one_unit():
    long = "one two three four five six. " + " ".join(f"w{i}" for i in range(60)) + ". Yes. No!"
    for text in ("Yes.", "a b", "Yes. No! Why? " + long, "日本語の行", "ẞ İ. " + long + "\n\nend"):
        spans = sorted((a, b) for a, b, _, _ in substring_dedup.units(text))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        rest = list(text)
        for a, b in spans:
            rest[a:b] = " " * (b - a)
        assert not substring_dedup._WORD.search("".join(rest))


def test_runs_of_short_sentences_repeat(spark):
    passage = " ".join(f"Word{i}{'!?.'[i % 3]}" for i in range(60))
    docs = [(1, "All rights reserved\n" + passage), (2, "some text of its own here. " + passage + "\nall rights reserved"), (3, "Nothing. " + "ours alone in here today\nAll rights reserved"), (4, "Nothing. But other words follow it now")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = substring_dedup.substring_duplicates(frame).collect()
    assert {r["doc_id"] for r in rows} == {2} and all(r["keep_doc_id"] == 1 for r in rows)
    assert sum(r["n_words"] for r in rows) == 63
    assert {r["doc_id"]: r["text"] for r in substring_dedup.cleaned(frame).collect()}[2].split() == "some text of its own here.".split()


def test_spans_match_brute_force(spark):
    import random

    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 30))).capitalize() + "." for _ in range(40)]
    docs = [(i % 90 if i % 17 else None, rng.choice([" ", "\n"]).join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(120)] + [(7, None), (8, ""), (200, "one two " * 20_000)]
    docs += docs[3:5]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, no int, d1 string")
    seen, want = {}, []
    hashed = {(r["doc_id"], r["text"]): r["row"] for r in frame.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as row").collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashed[d]))
    for d, t in order:
        found = substring_dedup.units(t or "")
        mine = (d, hashed[d, t])
        later = []
        for a, _, _, digest in found:
            first = seen.setdefault(digest, (*mine, a))
            later.append(first != (*mine, a))
        at = 0
        while at < len(found):
            end = at
            while end < len(found) and later[end]:
                end += 1
            if end > at and sum(x[2] for x in found[at:end]) >= 24:
                want += [(str(d), *x[:3]) for x in found[at:end]]
            at = max(end, at + 1)
    got = [(str(r["doc_id"]), r["start"], r["end"], r["n_words"]) for r in substring_dedup.substring_duplicates(frame).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)
