"""Null, tied, repeated, empty and clashing rows in the stages that filter."""

import corpus_pipeline
from wirescore.llm import decontaminate, exact_dedup, language_id, simhash_dedup, substring_dedup, suffix_dedup, token_counts, bpe_reuse

SCHEMA = "doc_id bigint, text string, lang string, bad_id bigint, kept_id bigint, k0 string, v bigint, r string, root bigint, n_chars bigint"
ITEM = "the quick brown foxes jump over lazy sleeping dogs near seven quiet rivers today"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, None, "a", 2, "b", None, None if t is None else len(t)) for d, t in rows], SCHEMA)


def test_near_duplicates_keep_one(spark):
    rows = [(None, "one two three four five six"), (None, "alone without a number at all here"), (3, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (5, None), (6, ""), (None, None)]
    kept = simhash_dedup.dedup_stage(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect())
    assert got == [("2", "one two three four five six"), ("5", "None"), ("None", "alone without a number at all here")]


def test_leaks_go_whoever_they_are(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, "eight plain words that stand alone in here"), (2, None), (3, "")], "item_id bigint, text string")
    rows = [(None, "x " + ITEM + " y"), (None, "clean"), (1, ITEM.replace("lazy", "idle")), (2, None), (2, None), (4, ""), (5, "so eight plain words that stand alone in here, yes"), (6, "word " * 60_000)]
    kept = decontaminate.decontaminate_stage(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert sorted((str(r["doc_id"]), str(r["text"])[:5]) for r in kept.collect()) == [("2", "None"), ("2", "None"), ("4", ""), ("6", "word "), ("None", "clean")]


def test_seeds_tolerate_substitutions_like_brute_force(spark):
    """Every pair of a document and an item whose best aligned run has enough equal words, found by trying all alignments."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    items = [(i, [word() for _ in range(rng.randint(12, 40))]) for i in range(30)]
    docs = []
    for d in range(120):
        own = list(items[d % 30][1])
        for _ in range(d % 5):
            own[rng.randrange(len(own))] = word()
        docs.append((d, [*(word() for _ in range(rng.randint(0, 30))), *own, *(word() for _ in range(rng.randint(0, 30)))]))
    want = {}
    for d, text in docs:
        for i, item in items:
            for diagonal in range(-len(item) + 1, len(text)):
                run = best = matches = 0
                for at in range(max(0, diagonal), min(len(text), len(item) + diagonal)):
                    same = text[at] == item[at - diagonal]
                    if run < 0:
                        run = matches = 0
                    run += 1 if same else -4
                    matches += same
                    if run > best:
                        best, found = run, matches
                if best and found >= min(10, len(item)):
                    want[d, i] = max(want.get((d, i), 0), found)
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matches"] for r in decontaminate.contaminated(table, bench).collect()}
    assert len(want) > 100 and got == want


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for made in (simhash_dedup.dedup_stage(docs), decontaminate.decontaminate_stage(docs, bench), language_id.filter_stage(docs)):
        assert made.columns == docs.columns and made.collect() == []
    for made in (exact_dedup.exact_duplicates(docs), suffix_dedup.suffix_duplicates(docs), substring_dedup.substring_duplicates(docs), token_counts.count_tokens(docs), bpe_reuse.round_trip(docs)):
        assert made.collect() == []


def test_long_texts_keep_their_margin():
    model = language_id.LanguageModel(("en", "de"), (b"the cat and the dog of the house with that " * 50, b"der hund und die katze von dem haus mit das " * 50))
    words = "the dog and the cat with that house of the "
    _, short, _ = language_id.predict_one(model, words * 3)
    lang, long, rejected = language_id.predict_one(model, words * 100_000)
    assert lang == "en" and not rejected and short > 0 and long > 0


def test_language_is_the_argmin_of_compressed_sizes(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, ~language_id.held_out())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language_id.identify(docs).collect():
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
            continue
        sizes = []
        for content in model.dictionaries:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made = zstandard.ZstdCompressor(level=model.level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(made.compress(language_id.fold(text))))
        assert r["lang_pred"] == model.languages[sizes.index(min(sizes))]


def test_pipeline_rows_follow_from_its_stages(spark, tmp_path):
    """run() is each stage's decision taken one after another, computed here by plain loops."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r["doc_id"] for r in language_id.identify(docs).where("rejected").collect()}
    known = docs.where(~docs["doc_id"].isin(sorted(rejected)))
    gone = {}
    from wirescore.llm import line_dedup

    for r in line_dedup.line_duplicates(known).collect():
        gone.setdefault(r["doc_id"], set()).add(r["line_no"])
    texts = {}
    for r in known.collect():
        lines = r["text"].split("\n") if r["text"] is not None else []
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone.get(r["doc_id"], ()))
        if r["doc_id"] not in gone or any(c.isalnum() for c in text):
            texts[r["doc_id"]] = text
    now = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    prints = {d: simhash_dedup.shingle_hashes(t) for d, t in texts.items()}
    bits = {d: sum(1 << b for b in range(64) if 2 * int(((h >> b) & 1).sum()) > len(h)) if len(h) else 0 for d, h in prints.items()}
    root = {d: d for d in bits}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bits)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (bits[a] ^ bits[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    singles = [d for d in ids if top(d) == d]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontaminate.contaminated(now, bench).collect()}
    want = {(d, len(bpe_reuse_ids(texts[d]))) for d in singles if d not in leaks}
    got = {(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and rejected and leaks


def bpe_reuse_ids(text):
    from tokenizers import Tokenizer

    from wirescore.llm.common import tokenizer_path

    made = bpe_reuse_ids.__dict__.setdefault("made", Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")))
    made.no_truncation()
    return made.encode(text, add_special_tokens=False).ids
