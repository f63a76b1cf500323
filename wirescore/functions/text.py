"""Scalar text functions: normalisation, edit counts, numeric entities, subsequences."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: A word character, and what may stand between the digits of a phone number.
_WORD = r"[\p{L}\p{N}_]"
_BETWEEN = r"[\p{IsWhite_Space}\x1c-\x1f()\-]"
ENTITY = rf"(?<!{_WORD})(?:\+?(?:[0-9]{_BETWEEN}*){{6,}}[0-9]|[0-9]+)(?!{_WORD})"
PHONE_DIGITS = 7


class _Blanks(dict):
    """Code points as they are, but punctuation and symbols as a space; each is looked up once."""

    def __missing__(self, code: int) -> int:
        self[code] = found = 32 if unicodedata.category(chr(code))[0] in "PS" else code
        return found


_BLANKS = _Blanks()


def normalised(text: str | None) -> str | None:
    """NFKC, case folding, punctuation and symbols to spaces, white space collapsed."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).casefold().translate(_BLANKS).split())


@F.pandas_udf(StringType())
def _normalised(text: pd.Series) -> pd.Series:
    return text.map(normalised)


def normalize_text(text: Column | str) -> Column:
    """normalised() of a column. A text of ASCII characters has no forms to fold, so it stays in the JVM; only the others go
    through Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    here = F.trim(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~\x09-\x0d\x1c-\x20]+", " "))
    return F.when(plain, here).otherwise(_normalised(F.when(~plain, text)))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def _places(words) -> dict:
    """For each word, an integer with a bit for each place where it stands."""
    found: dict = {}
    for i, word in enumerate(words):
        found[word] = found.get(word, 0) | 1 << i
    return found


def distance(a, b) -> int:
    """Levenshtein distance of two lists or texts by bit vectors: a column of the table of distances is kept as the bits of where it
    steps up and down, and one word of b moves the whole column on by a few operations on integers of len(a) bits."""
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[first:], b[first:]
    last = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - last], b[: len(b) - last]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) < len(b):  # wide integers cost less than many steps
        a, b = b, a
    places, every, bottom = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, total = every, 0, len(a)
    for word in b:
        equal = places.get(word, 0)
        still = (((equal & up) + up) ^ up) | equal | down
        right_up, right_down = down | ~(still | up), up & still
        total += bool(right_up & bottom) - bool(right_down & bottom)
        right_up, right_down = right_up << 1 | 1, right_down << 1
        up, down = (right_down | ~(still | right_up)) & every, right_up & still & every
    return total


def common_length(a, b) -> int:
    """Length of the longest common subsequence of two lists by a bit vector: a zero is a place of a where the length grows."""
    places, every = _places(a), (1 << len(a)) - 1
    state = every
    for word in b:
        met = state & places.get(word, 0)
        state = (state + met | state - met) & every
    return len(a) - state.bit_count()


def _of_pairs(function):
    """A column of a function of two arrays, many pairs at a time; null where one of them is."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else function(a.tolist(), b.tolist()) for a, b in zip(left, right)], dtype="Int32")

    return F.pandas_udf(run, IntegerType())


#: Levenshtein distance of two word lists.
word_edits = _of_pairs(distance)


@F.pandas_udf(IntegerType())
def character_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Levenshtein distance of two texts without their spaces."""
    return pd.Series([None if a is None or b is None else distance(a.replace(" ", ""), b.replace(" ", "")) for a, b in zip(reference, hypothesis)], dtype="Int32")


def error_rate(edits: Column, units: Column) -> Column:
    """Edits for each reference unit; an empty reference counts as one unit."""
    return edits / F.greatest(F.lit(1), units)


def numeric_entities(text: Column) -> Column:
    """An array of (kind, surface, canonical) in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    digits = lambda s: F.char_length(F.regexp_replace(s, "[^0-9]", ""))

    def entity(s: Column) -> Column:
        phone = digits(s) >= PHONE_DIGITS
        return F.struct(F.when(phone, "phone").otherwise("number").alias("kind"), s.alias("surface"), F.regexp_replace(s, "[^0-9+]", "").alias("canonical"))

    return F.transform(found, entity)


#: Length of the longest common subsequence of two arrays.
lcs_length = _of_pairs(common_length)
