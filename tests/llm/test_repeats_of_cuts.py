import random

from test_llm import brute_spans, frame

from wirescore.llm import suffix_dedup


def test_cuts_of_the_same_texts(spark):
    """Copies that begin and end anywhere: pieces that stand twice beside others that share only their middle."""
    rng = random.Random(12)
    docs = []
    for _ in range(80):
        base = "".join(rng.choice("abcdefgh") for _ in range(600))
        for _ in range(5):
            at = rng.randrange(300)
            cut = base[at : rng.randrange(at + 200, 600)]
            lead = "".join(rng.choice("ij") for _ in range(rng.randrange(9)))
            docs.append((len(docs), lead + cut + "klmno"[rng.randrange(5)]))
    got = sorted(str(tuple(r)) for r in suffix_dedup.suffix_duplicates(frame(spark, docs)).collect())
    assert got == brute_spans(docs, 200)
