"""Categories of pairs, as case expressions over profiled pairs (columns s_* and t_*).

Besides the profile of the features they use the raw name and address, n_sig, n_tokens
and a_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions import similarity as S

from .features import PROFILE

COLUMNS = [*PROFILE, "business_name", "business_address", "n_sig"]


def _jaccard(name: str) -> Column:
    return S.jaccard(F.col(f"s_{name}"), F.col(f"t_{name}"))


def missed_pair(dba: float = 0.4) -> Column:
    """Why blocking missed a true pair."""
    s, t = F.col("s_n_sig"), F.col("t_n_sig")
    overlap = S.shared(F.col("s_f_tokens"), F.col("t_f_tokens"))
    return (
        F.when(~F.col("t_f_has_address"), "missing_target_address")
        .when(F.col("t_f_non_latin") & ~F.col("s_f_non_latin"), "transliteration_indic_name")
        .when((F.size(s) > 0) & (F.size(t) > 0) & (s == t), "legal_suffix_only")
        .when(F.array_sort(s) == F.array_sort(t), "word_order_transposition")
        .when((F.size("t_f_numbers") == 0) & (F.size("s_f_numbers") > 0), "missing_street_number")
        .when((overlap == 0) & (_jaccard("f_atokens") >= dba), "trade_name_or_dba")
        .when(overlap > 0, "name_typo_or_abbreviation")
        .otherwise("unknown")
    )


def unbiased_pair() -> Column:
    """What kind of pair it is, by what is seen of the pair alone."""
    number = (F.col("s_f_street") != "") & (F.col("s_f_street") == F.col("t_f_street"))
    return (
        F.when(F.col("s_f_non_latin") != F.col("t_f_non_latin"), "transliteration")
        .when(~F.col("t_f_has_address"), "missing_target_address")
        .when((F.col("s_n_alnum") != "") & (F.col("s_n_alnum") == F.col("t_n_alnum")), "exact_name_match")
        .when(_jaccard("f_sig") >= 0.5, "high_name_similarity")
        .when((_jaccard("f_atokens") >= 0.35) | number, "low_name_sim_same_address")
        .when((F.size("s_f_numbers") > 0) & (F.size("t_f_numbers") == 0), "missing_street_number")
        .otherwise("other_low_similarity")
    )


def false_positive() -> Column:
    names = lambda s: F.split(f"{s}_n_alnum", " ")
    words = F.filter(F.array_intersect(names("s"), names("t")), lambda x: x != "")
    return (
        F.when(F.col("s_n_alnum") == F.col("t_n_alnum"), "same_brand_different_branch")
        .when((F.col("s_a_clean") == F.col("t_a_clean")) & (F.col("s_a_clean") != ""), "same_address_co_location")
        .when(F.size(words) > 0, "partial_name_overlap_collision")
        .otherwise("other_distractor")
    )


def false_negative(threshold: float) -> Column:
    """``score``: the pair's, 0 if it was no candidate."""
    return (
        F.when(~F.col("t_f_has_address"), "missing_target_address")
        .when(F.col("t_f_non_latin") & ~F.col("s_f_non_latin"), "transliteration_mismatch")
        .when(F.col("score") == 0, "unretrieved_by_candidate_policy")
        .when(F.col("score") < threshold, "score_below_decision_threshold")
        .otherwise("margin_or_conflict_pruned")
    )


def is_hard(name_high: float, address_low: float, address_high: float, name_low: float, number_name: float) -> Column:
    """Whether a pair that is no match looks like one."""
    name, address = _jaccard("f_sig"), _jaccard("f_atokens")
    number = (F.col("s_f_street") != "") & (F.col("s_f_street") == F.col("t_f_street"))
    return ((name >= name_high) & (address < address_low)) | ((address >= address_high) & (name < name_low)) | (number & (name >= number_name)) | (F.col("hits") >= 2)


def theory() -> dict[str, Column]:
    """Predicates of which keys could find a pair: one a channel, and the unions of five configurations."""
    equal = lambda n: (F.col(f"s_{n}") != "") & (F.col(f"s_{n}") == F.col(f"t_{n}"))
    number = (F.col("s_f_street") != "") & (F.col("s_f_street") == F.col("t_f_street"))
    base = equal("ch1") | equal("ch2") | equal("ch3") | equal("ch4")
    grams = _jaccard("f_char3") >= 0.35
    token = F.arrays_overlap("s_f_sig", "t_f_sig")
    street = number & F.arrays_overlap("s_f_awords", "t_f_awords")
    return {"config_a": base, "config_b": base | grams, "config_c": base | token, "config_d": base | street, "config_e": base | grams | token | street}
