"""Blocking keys and n-grams as column expressions over normalized columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_number, plain_number, without_ordinal, words_in, with_normalized
from .words import ADDRESS_STOPWORDS


def name_key(sig: Column, alnum: Column) -> Column:
    """ch1: the significant tokens, or all."""
    return F.when(F.size(sig) > 0, F.array_join(sig, " ")).otherwise(alnum)


def sorted_key(sig: Column, tokens: Column, n: int) -> Column:
    """ch2: the first ``n`` of the sorted words, so that their order does not matter."""
    def words(a: Column) -> Column:
        return F.filter(a, lambda t: ~is_number(t) & (F.char_length(t) >= 2))

    return F.array_join(F.slice(F.array_sort(F.when(F.size(words(sig)) > 0, words(sig)).otherwise(words(tokens))), 1, n), "_")


def street_words(tokens: Column) -> Column:
    """Address tokens that may name a street or a place."""
    stop = words_in(ADDRESS_STOPWORDS)
    return F.filter(tokens, lambda t: ~is_number(t) & (F.char_length(t) >= 3) & ~F.array_contains(stop, t))


def street_key(numbers: Column, words: Column, last: bool = False) -> Column:
    """ch3: the first number and the first street word; ch4: and the last. Empty without both."""
    word = F.try_element_at(words, F.lit(-1 if last else 1))
    return F.coalesce(F.concat(plain_number(F.get(numbers, 0)), F.lit("_"), word), F.lit(""))


def relaxed_street_keys(numbers: Column, words: Column) -> Column:
    """ch7: the first number with every different street word."""
    number = plain_number(F.get(numbers, 0))
    return F.when(F.size(numbers) > 0, F.transform(F.array_distinct(F.transform(words, lambda w: without_ordinal(w))), lambda w: F.concat(number, F.lit("_"), w))).otherwise(F.array().cast("array<string>"))


def distinctive(sig: Column) -> Column:
    """ch6: significant tokens of three or more letters."""
    return F.filter(sig, lambda t: ~is_number(t) & (F.char_length(t) >= 3))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def char_ngrams(text: Column, n: int, short: bool) -> Column:
    """Different runs of ``n`` characters; of a shorter text the text itself (``short``) or nothing."""
    whole = F.when(F.lit(short) & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(grams)).otherwise(whole)


def combined_char_ngrams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    def marked(n: int) -> Column:
        return F.transform(char_ngrams(text, n, True), lambda g: F.concat(F.lit(f"{n}g_"), g))

    return F.array_distinct(F.concat(*map(marked, sizes)))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_ngrams(text: Column, n: int = 2) -> Column:
    t = word_tokens(text)
    runs = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), "_"))
    return F.when(F.size(t) >= n, F.array_distinct(runs)).when(F.size(t) > 0, F.array(F.array_join(t, "_"))).otherwise(F.array().cast("array<string>"))


def token_set(text: Column, least: int = 2) -> Column:
    return F.array_distinct(F.filter(word_tokens(text), lambda t: F.char_length(t) >= least))


def prefix_keys(text: Column, n: int = 4) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))
    tokens = F.filter(F.split(clean, r"\s+"), lambda t: F.char_length(t) >= n)
    first = F.when(clean != "", F.array(F.concat(F.lit("pref_"), F.substring(clean, 1, n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, F.transform(tokens, lambda t: F.concat(F.lit("tokpref_"), F.substring(t, 1, n)))))


def ngrams(text: Column, mode: str) -> Column:
    """char_2, char_3, char_4, char_2_3, char_3_4, token_1, token_2 or prefix_4."""
    kind, *sizes = mode.split("_")
    sizes = [int(x) for x in sizes]
    if kind == "char":
        return char_ngrams(squeezed(text), sizes[0], True) if len(sizes) == 1 else combined_char_ngrams(squeezed(text), tuple(sizes))
    if kind == "token":
        return token_set(text) if sizes == [1] else token_ngrams(text, sizes[0])
    if kind == "prefix":
        return prefix_keys(text, sizes[0])
    raise ValueError(f"unknown kind of n-gram: {mode}")


def with_profiles(records: DataFrame) -> DataFrame:
    """Records with all normalized forms, keys and sets that blocking and features use; each computed once.

    Adds n_* (name), a_* (address), ch1 to ch7 and the sets of both feature vectors.
    """
    df = with_normalized(with_normalized(records, "business_name", "n_", True), "business_address", "a_", False)
    df = df.withColumns({"ch1": name_key(F.col("n_sig"), F.col("n_alnum")), "a_words": street_words(F.col("a_tokens"))})
    c = F.col
    return df.withColumns(
        {
            "ch2_top1": sorted_key(c("n_sig"), c("n_tokens"), 1),
            "ch2": sorted_key(c("n_sig"), c("n_tokens"), 2),
            "ch2_top3": sorted_key(c("n_sig"), c("n_tokens"), 3),
            "ch3": street_key(c("a_numbers"), c("a_words")),
            "ch4": street_key(c("a_numbers"), c("a_words"), last=True),
            "ch6": F.array_distinct(distinctive(c("n_sig"))),
            "ch7": relaxed_street_keys(c("a_numbers"), c("a_words")),
            "f_sig": F.array_distinct("n_sig"),
            "f_tokens": F.array_distinct("n_tokens"),
            "f_char2": char_ngrams(c("n_alnum"), 2, False),
            "f_char3": char_ngrams(c("n_alnum"), 3, False),
            "f_char4": char_ngrams(c("n_alnum"), 4, False),
            "f_atokens": F.array_distinct("a_tokens"),
            "f_awords": F.array_distinct("a_words"),
            "f_achar3": char_ngrams(c("a_clean"), 3, False),
            "f_numbers": F.array_distinct("a_numbers"),
            "f_street": F.coalesce(F.get("a_numbers", F.lit(0)), F.lit("")),
            "f_postal": F.when(F.size("a_numbers") >= 2, F.element_at("a_numbers", -1)).otherwise(""),
            "f_locality": F.array_distinct(F.when(F.size("a_tokens") >= 3, F.slice("a_tokens", -3, 3)).otherwise(c("a_tokens"))),
            "f_non_latin": c("business_name").rlike("[ऀ-ൿ]"),
            "f_has_address": F.regexp_replace("business_address", r"(?U)\s", "") != "",
        }
    )
