"""BPE encoding and decoding with content-defined chunk reuse.

Lower-cased texts are cut where a rolling hash over the last eight bytes says so, so passages
that documents share fall into the same chunks, wherever they begin. A worker encodes a chunk
once and reuses its ids. A cut may fall inside a word, so only what lies
between the first and the last white space of a chunk is reused; at each join, the end of one
chunk and the beginning of the next are put together and encoded anew, and the region grows
chunk by chunk until white space stands on both of its sides. No pre-token of this tokenizer
crosses white space, so from there on both encodings agree exactly.

Inside a chunk, words that were seen before are looked up as well. Texts with characters outside
the ranges in which Python's and the library's normalisation and character classes are known
to agree, and texts that hold a special token's string, are encoded whole by the library.

Edge cases. A null text counts as empty: no ids, and the decoded text is empty. Each input row
gives one row, repeated rows included; very long texts are worked through whole. Caches are
bounded; when one is full, a new generation begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quiet_tokenizers, slices, tokenizer_path
from .token_counts import special_strings

#: The pre-token pattern of the tokenizer, for lower-cased texts without UNSAFE.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
UNSAFE = re.compile("[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿА-я]")
SPACES = " \t\n\r\x0b\x0c"
#: A cut follows about one byte in so many.
CHUNK = 1024

RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def cuts(raw: bytes, chunk: int = CHUNK) -> list[int]:
    """Content-defined cut positions inside raw, none of them within a character."""
    if len(raw) < 9:
        return []
    data = np.frombuffer(raw, np.uint8)
    words = np.ndarray((len(raw) - 7,), np.dtype("<u8"), buffer=raw, strides=(1,))
    with np.errstate(over="ignore"):
        rolled = (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(chunk).bit_length() + 1)
    at = np.flatnonzero(rolled == 0) + 8
    at = at[at < len(raw)]
    return at[(data[at] & 0xC0) != 0x80].tolist()


class Encoder:
    """Encodes and decodes in one worker."""

    def __init__(self, path: str, word_entries: int, chunk_bytes: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = special_strings(path)
        self.word_entries, self.chunk_bytes = word_entries, chunk_bytes
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple[str, bytes, str]] = {}
        self.held = 0
        # The decoder of this tokenizer puts one space between the strings of the tokens.
        tokens = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.strings = np.frombuffer(b"".join(tokens), np.uint8)

    def whole(self, text: str) -> bool:
        return bool(UNSAFE.search(text)) or any(s in text for s in self.special)

    def plain(self, text: str) -> bytes:
        """The ids of lower-cased text that begins and ends at white space."""
        words = PRE_TOKENS.findall(text)
        ids = list(map(self.known.get, words))
        while None in ids:  # more than once only if a new generation of the cache began
            self.learn({w for w, i in zip(words, ids) if i is None})
            ids = list(map(self.known.get, words))
        return b"".join(ids)

    def learn(self, missing: set[str]) -> None:
        """Take words over from the last generation of the cache; encode the others in one text,
        with a space between them, which no pre-token crosses."""
        if len(self.known) + len(missing) > self.word_entries:
            self.last, self.known = self.known, {}
        last, new = self.last, []
        for w in missing:
            if w in last:
                self.known[w] = last[w]
            else:
                new.append(w)
        if new:
            made = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
            ids, of = np.array(made.ids, "<u4"), np.array(made.word_ids)
            edge = np.searchsorted(of, np.arange(len(new) + 1)).tolist()
            raw = ids.tobytes()
            for w, a, b in zip(new, edge, edge[1:]):
                self.known[w] = raw[4 * a : 4 * b]

    def chunk(self, raw: bytes) -> tuple[str, bytes, str] | None:
        """(head, ids, tail) of a chunk; None if there is no white space in it."""
        found = self.chunks.get(raw)
        if found is None:
            text = raw.decode()
            at = [i for i in map(text.find, SPACES) if i >= 0]
            if not at:
                return None
            first, last = min(at), max(map(text.rfind, SPACES))
            found = (text[:first], self.plain(text[first:last]), text[last + 1 :])
            if self.held > self.chunk_bytes:
                self.chunks.clear()
                self.held = 0
            self.chunks[raw] = found
            self.held += len(raw) + len(found[1]) + 400
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        raw = text.lower().encode()
        ids, join, at = [], "", 0
        for to in [*cuts(raw), len(raw)]:
            piece, at = raw[at:to], to
            found = self.chunk(piece)
            if found is None:
                join += piece.decode()
            else:
                ids += (self.plain(join + found[0]), found[1])
                join = found[2]
        ids.append(self.plain(join))
        return b"".join(ids)

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The UTF-8 text of each of some texts' ids."""
        ids = np.frombuffer(b"".join(encoded), "<u4")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.begins[ids] - (ends - sizes), sizes)
        text = self.strings[source].tobytes()
        edge = np.r_[0, ends][np.r_[0, np.cumsum([len(e) // 4 for e in encoded])]].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(edge, edge[1:])]


_WORKERS: dict[str, Encoder] = {}


def _encoder(path: str, word_entries: int, chunk_bytes: int) -> Encoder:
    quiet_tokenizers()
    if path not in _WORKERS:
        _WORKERS[path] = Encoder(path, word_entries, chunk_bytes)
    return _WORKERS[path]


def encoded(text: Column, path: str | None = None, word_entries: int = 400_000, chunk_bytes: int = 48 << 20) -> Column:
    """A struct column (n_tokens, ids as little-endian 32-bit integers, decoded)."""
    path = path or tokenizer_path("word_bpe_49k.json")

    @F.arrow_udf(returnType=RESULT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path, word_entries, chunk_bytes)
        for batch in batches:
            ids = list(map(encoder.encode, (t or "" for t in batch.to_pylist())))
            texts = [t.decode() for a, b in slices([len(i) for i in ids], 1 << 20) for t in encoder.decode(ids[a:b])]
            yield pa.StructArray.from_arrays([pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["n_tokens", "ids", "decoded"])

    return encode(text)


def digests(text: Column, path: str | None = None, word_entries: int = 400_000, chunk_bytes: int = 48 << 20) -> Column:
    """A struct column (n_tokens, ids_sha256, decoded_sha256); ids and texts do not leave the worker."""
    path = path or tokenizer_path("word_bpe_49k.json")

    @F.arrow_udf(returnType=DIGESTS)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path, word_entries, chunk_bytes)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            n, i, d = [], [], []
            for a, b in slices([len(t) for t in texts], 1 << 19):
                ids = list(map(encoder.encode, texts[a:b]))
                n += [len(x) // 4 for x in ids]
                i += [hashlib.sha256(x).hexdigest() for x in ids]
                d += [hashlib.sha256(x).hexdigest() for x in encoder.decode(ids)]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(text)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Rows doc_id, n_tokens, ids_sha256, decoded_sha256: one for each row of docs."""
    return docs.select("doc_id", digests(F.col("text"), **options).alias("e")).select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")
