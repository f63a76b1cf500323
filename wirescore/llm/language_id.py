"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from a bounded sample of its
training texts. A text is lower-cased, its runs of non-letters become single spaces, and it
is compressed with every dictionary; the language whose dictionary gives the fewest bytes
wins. The margin is the share by which the runner-up is larger; below `min_margin` the
prediction is kept but marked as rejected.

Edge cases. A null text, or one without a letter, gets `und`, score 0, and is rejected. Equal
sizes go to the language with more training rows, then to the first by name. Without any
training row every text gets `und`. Repeated rows are treated alike, and other columns are
never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
#: A long text is compressed in blocks of so many bytes, each against the fresh dictionary, so that what a
#: dictionary saves, and with it the margin, does not fade with the length.
BLOCK = 256 << 10
#: ASCII bytes that are not letters become spaces; bytes of other characters stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
ARROW_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


@dataclass(frozen=True)
class LanguageModel:
    """Languages in the order in which ties are settled, with their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 5
    min_margin: float = 0.01


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def fit(
    docs: DataFrame,
    training: Column,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    dictionary_bytes: int = 256 << 10,
    sample_rows: int = 300,
    longest_sample: int = 64 << 10,
    level: int = 5,
    min_margin: float = 0.01,
) -> LanguageModel:
    """Learn from the rows where `training` holds and the language is not null.

    The sample is bounded: about `sample_rows` rows a language, drawn by a hash of the key, of
    at most `longest_sample` characters each, and of them the first `dictionary_bytes`.
    """
    rows = docs.where(training & F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel((), (), level, min_margin)
    draw = F.xxhash64(F.coalesce("k", F.lit("")), F.lit(7))
    every = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, max(1, n // sample_rows))])
    some = rows.where((F.octet_length("t") > 0) & (F.pmod(draw, every[F.col("l")]) == 0))
    taken = some.select("l", F.substring("t", 1, longest_sample).alias("t"), draw.alias("o")).collect()
    best = sorted(counts, key=lambda l: (-counts[l], l))
    parts: dict[str, list[bytes]] = {l: [] for l in best}
    room = dict.fromkeys(best, dictionary_bytes)
    for r in sorted(taken, key=lambda r: (r["l"], r["o"], r["t"])):
        piece = (fold(r["t"]) + b" ")[: room[r["l"]]]
        if len(piece) > 1:
            parts[r["l"]].append(piece)
            room[r["l"]] -= len(piece)
    kept = tuple(l for l in best if parts[l])
    return LanguageModel(kept, tuple(b"".join(parts[l]) for l in kept), level, min_margin)


@lru_cache(maxsize=4)
def _compressors(model: LanguageModel) -> list:
    import zstandard

    made = []
    for content in model.dictionaries:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=model.level)
        made.append(zstandard.ZstdCompressor(level=model.level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def predict_one(model: LanguageModel, text: str | None) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is 1 - best / runner-up, so 0 for a tie."""
    folded = fold(text) if text else b""
    if not model.languages or not folded or not any(c.isalpha() for c in text):
        return UNDETERMINED, 0.0, True
    parts = [folded[i : i + BLOCK] for i in range(0, len(folded), BLOCK)]
    sizes = [sum(len(c.compress(part)) for part in parts) for c in _compressors(model)]
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if len(order) == 1:
        return model.languages[0], 1.0, False
    best, second = sizes[order[0]], sizes[order[1]]
    return model.languages[order[0]], 1 - best / second, (second - best) / best < model.min_margin


def predict(model: LanguageModel, text: Column) -> Column:
    """A struct column (lang_pred, score, rejected). The model, of bounded size, is broadcast."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf(returnType=RESULT)
    def classify(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang_pred", "score", "rejected"), predict_one(shared.value, t))) for t in texts.to_pylist()], type=ARROW_RESULT)

    return classify(text)


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the key's text leaves 0 modulo 5; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, **options) -> DataFrame:
    """Rows doc_id, held_out, lang_pred, score, rejected: one for each row of docs."""
    model = fit(docs, ~held_out(), **options)
    made = docs.select("doc_id", held_out().alias("held_out"), predict(model, F.col("text")).alias("p"))
    return made.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def filter_stage(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose language is rejected, null texts among them; repeated rows are judged
    alike, a null doc_id counts as the empty text; all columns as they came, whatever their names."""
    model = fit(docs, ~held_out(), **options)
    return docs.where(~predict(model, F.col("text"))["rejected"])
