"""Text normalization as column expressions; one Arrow UDF, for compatibility decomposition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .words import LEGAL_SUFFIXES, STOPWORDS

#: Scripts of India, whose combining signs are vowels and stay.
INDIC = ("ऀ", "ൿ")
# Fixed value: the ASCII punctuation that counts as a blank.
PUNCTUATION = r"""[.,;:!?"'/\\()\[\]{}<>~`@#$%^*_+=|-]"""


def _plain(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) or INDIC[0] <= c <= INDIC[1])


def _tables() -> tuple[str, str, str]:
    """Letters that decompose to one letter and signs, that letter for each, and a class of what may need more than that."""
    letters = [chr(i) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for i in range(a, b)]
    simple = {c: p for c in letters if (p := _plain(c)) != c and len(p) == 1}
    # What stands for itself, whatever stands beside it: no combining sign, and no decomposition.
    stable = [i for a, b in ((0, 0x250), (0x370, 0x590), (0x900, 0xD80), (0x4E00, 0xA000)) for i in range(a, b) if unicodedata.normalize("NFKD", chr(i)) == chr(i) and not unicodedata.combining(chr(i))]
    runs = []
    for i in stable:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(simple), "".join(simple.values()), "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


_ACCENTED, _BARE, _MORE = _tables()


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(_plain, na_action="ignore")


def without_accents(text: Column) -> Column:
    """NFKD without combining signs, those of Indic scripts excepted.

    Letters of the Latin scripts are replaced in place; only texts with something else
    that may decompose are sent to Python, the others as nulls.
    """
    replaced = F.translate(text, _ACCENTED, _BARE)
    more = replaced.rlike(_MORE)
    return F.when(more, _decomposed(F.when(more, text))).otherwise(replaced)


def words_in(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def stripped(text: Column) -> Column:
    """Without blanks of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def number_tokens(text: Column) -> Column:
    """Runs of digits that stand alone, in the text as it is: none in `45th`, `0684` in `AF-0684`."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\d+\b"), F.lit(0))


def plain_number(number: Column) -> Column:
    """Digits of any script as ASCII ones, without zeros in front; of any length."""
    digits = "".join(chr(base + i) for base in (0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0x660, 0x6F0, 0xFF10) for i in range(10))
    return F.regexp_replace(F.translate(number, digits, "0123456789" * (len(digits) // 10)), r"^0+(?=\d)", "")


def without_ordinal(token: Column) -> Column:
    """`42nd` as `42`."""
    return F.regexp_replace(F.lower(token), r"(\p{Nd}+)(st|nd|rd|th)$", "$1")


def spaced(cleaned: Column) -> Column:
    """Dotted abbreviations closed up, `&` spelled out, ASCII punctuation as blanks."""
    closed = F.regexp_replace(cleaned, r"(?U)\b([a-zA-Z0-9])\.", "$1")
    return stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(closed, "&", " and "), PUNCTUATION, " "), r"(?U)\s+", " "))


def is_non_latin(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{INDIC[0]}-{INDIC[1]}]"), F.lit(False))


def has_text(text: Column) -> Column:
    return F.coalesce(stripped(text) != "", F.lit(False))


def with_normalized(df: DataFrame, column: str, prefix: str, strip_legal: bool) -> DataFrame:
    """All representations of a text column, as columns that begin with ``prefix``.

    ascii, clean (lower case), tokens, alnum (tokens joined), numbers (of the raw text),
    legal (suffixes found), sig (significant tokens: without stop words and, with
    ``strip_legal``, without suffixes), top2 (the first two of them in order).
    Each is computed once: columns that later ones use twice are projected before.
    """
    raw, p = F.coalesce(F.col(column), F.lit("")), prefix
    df = df.withColumn(f"{p}ascii", F.when(has_text(raw), without_accents(raw)).otherwise(""))
    df = df.withColumn(f"{p}clean", stripped(F.lower(f"{p}ascii")))
    df = df.withColumns({f"{p}tokens": F.filter(F.split(spaced(F.col(f"{p}clean")), " "), lambda t: t != ""), f"{p}numbers": number_tokens(raw)})
    tokens = F.col(f"{p}tokens")
    legal, stop = words_in(LEGAL_SUFFIXES), words_in(STOPWORDS)
    df = df.withColumns(
        {
            f"{p}alnum": F.array_join(tokens, " "),
            f"{p}legal": F.filter(tokens, lambda t: F.array_contains(legal, t)),
            # A word that is both suffix and stop word counts as suffix.
            f"{p}sig": F.filter(tokens, lambda t: ~F.array_contains(stop, t) & ~F.array_contains(legal, t) if strip_legal else F.array_contains(legal, t) | ~F.array_contains(stop, t)),
        }
    )
    df = df.withColumn(f"{p}_words", F.filter(f"{p}sig", lambda t: ~is_number(t) & (F.char_length(t) >= 2)))
    words = F.col(f"{p}_words")
    return df.withColumn(f"{p}top2", F.array_sort(F.slice(F.when(F.size(words) > 0, words).otherwise(tokens), 1, 2))).drop(f"{p}_words")
