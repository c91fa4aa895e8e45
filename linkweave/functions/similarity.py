"""Similarities of strings and of sets of strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared over all, of arrays without repeats."""
    n = shared(a, b)
    of_sizes = n / F.greatest(F.lit(1), F.size(a) + F.size(b) - n)
    return of_sizes if not both_empty else F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(of_sizes)


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller."""
    return shared(a, b) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def directional(a: Column, b: Column) -> Column:
    """Shared over the first."""
    return shared(a, b) / F.greatest(F.lit(1), F.size(a))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.char_length(a), F.char_length(b)) / F.greatest(F.lit(1), F.char_length(a), F.char_length(b))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less distance over length; both empty: 1."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def quick_edit_ratio(a: Column, b: Column) -> Column:
    """The same, 0 if either is empty or their lengths differ by over 0.7 of the longer, without computing it."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    far = F.abs(F.char_length(a) - F.char_length(b)) > longest * F.lit(0.7)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == "") | far, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning over the longer length."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    least = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i <= least) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.size(same) / F.greatest(F.lit(1), longest)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def rarity(df: Column) -> Column:
    """Weight of a token by the number of records with it; 0 without one."""
    return F.when(df > 0, 1 / F.log(1 + df)).otherwise(F.lit(0.0))


def heuristic(exact: Column, name_jaccard: Column, shares_number: Column, address_jaccard: Column, hits: Column) -> Column:
    """Quick score of a candidate pair, 12.5 at most."""
    return F.when(exact, 3.0).otherwise(0.0) + 2.0 * name_jaccard + F.when(shares_number, 2.0).otherwise(0.0) + 1.5 * address_jaccard + F.least(hits, F.lit(4))
