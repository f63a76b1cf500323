"""Texts that the rolling hash does cut: chunk joins against the library."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from wirescore.llm import bpe_reuse
from wirescore.llm.common import tokenizer_path


def test_texts_with_cuts_agree_with_the_library(spark):
    rng = random.Random(21)
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    encoder = bpe_reuse.Encoder(path, 1000, 1 << 16)
    pool = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 11))) + rng.choice(["", "", ",", ".", "'s", "-", "42"]) for _ in range(60)) for _ in range(12)]
    texts, cut = [], 0
    for _ in range(80):
        text = rng.choice([" ", "\n", "  ", ""]).join(rng.choices(pool, k=rng.randint(2, 40)))
        texts.append(text)
        cut += len(list(bpe_reuse.cuts(text.lower().encode()))) if not encoder.whole(text) else 0
    assert cut > 200
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
    rows = bpe_reuse.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
