"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once: those that are
most frequent in a bounded sample of the corpus (`sample_rows` texts, `sample_chars` characters of
each), then entries of the tokenizer's vocabulary, `table_entries` in all, each encoded once
on the driver. What the sample holds changes the speed alone, never a count. Tier two is a cache in each Python worker: a pre-token that misses is encoded by the
library, once, and remembered; when the cache reaches `cache_entries` a new
generation begins, which takes over what it meets again. No
pre-token is ever shuffled.

Texts whose characters are outside the ranges in which Python's and the library's character
classes are known to agree, and texts that hold a special token's string, are encoded whole by
the library.

Edge cases. A null text counts as empty: 0 bytes, 0 tokens. Each input row gives one row,
repeated rows included; very long texts are worked through whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quiet_tokenizers, slices, tokenizer_path

#: The byte-level pre-token pattern, for the characters in SAFE.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Anything outside: ASCII text and white space, Latin letters, Cyrillic letters.
UNSAFE = re.compile("[^\t-\r\x20-\x7eÀ-ÖØ-öø-ſА-я]")

RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def frequent(texts: list[str], table_entries: int) -> list[str]:
    """The pre-tokens that some texts have more than once, most frequent first."""
    seen: dict[str, int] = {}
    for text in texts:
        if not UNSAFE.search(text):
            for word in PRE_TOKENS.findall(text):
                seen[word] = seen.get(word, 0) + 1
    return sorted((w for w, n in seen.items() if n > 1), key=lambda w: (-seen[w], w))[:table_entries]


def frequent_lengths(path: str, sample: list[str] = (), table_entries: int = 65_536) -> dict[str, int]:
    """Token counts of what is frequent in the sample, and then of the vocabulary's own strings, as pre-tokens."""
    from tokenizers import Tokenizer, decoders

    tokenizer = Tokenizer.from_file(path)
    vocabulary = sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
    read = decoders.ByteLevel()
    own = [w for t, _ in vocabulary if not UNSAFE.search(w := read.decode([t])) and PRE_TOKENS.fullmatch(w)]
    words = list(dict.fromkeys([*frequent(list(sample), table_entries), *own]))[:table_entries]
    return {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False))}


def piece_lengths(path: str) -> Callable[[list[str]], list[int]]:
    """A function that gives the token counts of single pre-tokens.

    A byte-level vocabulary whose ids follow the order of its merges is the same as a table of
    ranks, whose encoder takes a piece at a time without any of the bookkeeping of a text; any
    other vocabulary goes through the tokenizer itself.
    """
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    in_order = all(vocabulary.get(m.replace(" ", "")) == len(letters) + i for i, m in enumerate(merged)) and len(vocabulary) <= len(letters) + len(merged) + 1
    if not in_order or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
        return lambda words: [len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    spelt = {pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
    for b in range(0xC2, 0xF5):  # lead and continuation bytes, read off characters that hold them
        for c in (bytes([b, 0x80 + (0x20 if b == 0xE0 else 0x10 if b == 0xF0 else 0), 0x80, 0x80])[: 2 + (b >= 0xE0) + (b >= 0xF0)],):
            spelt[pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c.decode())[0][0][0]] = b
    for b in range(0x80, 0xC0):
        spelt[pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1]] = b
    for b in set(range(256)) - set(spelt.values()):  # bytes that no text has
        spelt[next(x for x in letters if x not in spelt)] = b
    ranks = {bytes(spelt[c] for c in t): i for t, i in vocabulary.items() if all(c in spelt for c in t)}
    ranks = {t: i for t, i in ranks.items() if i < len(letters) + len(merged)}
    core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda words: [len(core.encode_single_piece(w.encode())) for w in words]


class Counter:
    """Counts tokens in one worker."""

    def __init__(self, path: str, table: dict[str, int], cache_entries: int):
        from tokenizers import Tokenizer

        self.path, self.table, self.limit = path, table, cache_entries
        self.tokenizer = Tokenizer.from_file(path)
        self.special = special_strings(path)
        self.lengths = piece_lengths(path)
        self.known = dict(table)
        self.last: dict[str, int] = {}

    def whole(self, text: str) -> bool:
        return bool(UNSAFE.search(text)) or any(s in text for s in self.special)

    def learn(self, words: set[str]) -> None:
        """Take lengths over from the last generation of the cache; encode the other words."""
        if len(self.known) + len(words) > self.limit:
            self.last, self.known = self.known, dict(self.table)
        last, new = self.last, []
        for w in words:
            if w in last:
                self.known[w] = last[w]
            else:
                new.append(w)
        self.known.update(zip(new, self.lengths(new)))

    def counts(self, texts: list[str]) -> list[int]:
        out, find = [0] * len(texts), PRE_TOKENS.findall
        split = {i: find(t) for i, t in enumerate(texts) if not self.whole(t)}
        todo = list(split)
        while todo:  # again only if a new generation of the cache began
            get, missing, again = self.known.get, set(), []
            for i in todo:
                lengths = list(map(get, split[i]))
                if None in lengths:
                    missing.update(w for w, n in zip(split[i], lengths) if n is None)
                    again.append(i)
                else:
                    out[i] = sum(lengths)
            if missing:
                self.learn(missing)
            todo = again
        for i, t in enumerate(texts):
            if i not in split:
                out[i] = len(self.tokenizer.encode(t, add_special_tokens=False).ids)
        return out


#: In a worker: the counter of the last table, with its cache.
_WORKERS: dict[tuple[str, int], Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", cache_entries: int = 800_000, slice_bytes: int = 1 << 20, sample_rows: int = 2000, sample_chars: int = 1 << 14) -> Column:
    """A struct column (n_bytes, n_tokens) for the text column of docs."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    quiet_tokenizers()
    sample = docs.where(F.col(text).isNotNull()).select(F.substring(text, 1, sample_chars).alias("t")).limit(sample_rows).collect()
    table = frequent_lengths(path, [r["t"] for r in sample])
    shared = docs.sparkSession.sparkContext.broadcast(table)
    mine = hash(frozenset(table))

    @F.arrow_udf(returnType=RESULT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        quiet_tokenizers()
        key = (path, mine)
        if key not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[key] = Counter(path, shared.value, cache_entries)
        counter = _WORKERS[key]
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            tokens: list[int] = []
            for a, b in slices(sizes, slice_bytes):
                tokens += counter.counts(texts[a:b])
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["n_bytes", "n_tokens"])

    return count(F.col(text))


def count_tokens(docs: DataFrame, limit: int = 512, **options) -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens, over_limit: one for each row of docs."""
    made = docs.select("doc_id", token_counts(docs, **options).alias("c"))
    return made.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
