"""The two feature vectors of a candidate pair, one projection each.

``pairs``: s1_id, tid, channel_mask, hits, rarest_token_df, ch5_score (and ranker_score,
ranker_rank for the matcher).  Profiles are joined by id; the columns of the record are
prefixed s_, those of the target t_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions import similarity as S

from . import lookup

PROFILE = ["country", "n_alnum", "f_sig", "f_tokens", "f_char2", "f_char3", "f_char4", "a_clean", "f_atokens", "f_awords", "f_achar3", "f_numbers", "f_street", "f_postal", "f_locality", "f_non_latin", "f_has_address"]


# The published names of the features, in their order, which models and tables are exchanged by.
CHANNEL_FLAGS = ["ch1_core_name_hit", "ch2_top2_tokens_hit", "ch3_street_num_hit", "ch4_address_hit", "ch5_char3_hit", "ch6_distinctive_token_hit", "ch7_relaxed_street_hit"]


def with_profiles_of(pairs: DataFrame, queries: DataFrame, targets: DataFrame, columns: list[str] = PROFILE) -> DataFrame:
    """Pairs with both profiles.  Pairs are narrow and profiles wide, so it is the join of the pairs that is shuffled last."""
    s = queries.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"s_{c}") for c in columns])
    t = targets.select(F.col("entity_id").alias("tid"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return pairs.join(t, "tid").join(s, "s1_id")


#: Those of them that the ranker's features read.
RANKER_PROFILE = ["country", "n_alnum", "f_sig", "f_tokens", "f_char2", "f_char3", "f_char4", "f_atokens", "f_achar3", "f_street", "f_postal", "f_non_latin", "f_has_address"]
#: Sets of which only sizes and intersections count: look-ups send 64-bit hashes of their members.
HASHED = ("f_char2", "f_char3", "f_char4", "f_achar3")


def looked_up(pairs: DataFrame, queries: DataFrame, targets: DataFrame, columns: list[str] = PROFILE, slices: lookup.Slices | None = None) -> DataFrame:
    """The same rows, for many columns of many pairs: only the pairs are shuffled, or nothing if they are stored in ``slices``.  Every column costs, read or not."""
    sent = [F.transform(c, lambda x: F.xxhash64(x)).alias(c) if c in HASHED else F.col(c) for c in columns]
    return lookup.with_profiles_of(pairs, queries.select("entity_id", *sent), targets.select("entity_id", *sent), columns, slices)


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _both(f, name: str) -> Column:
    return f(F.col(f"s_{name}"), F.col(f"t_{name}"))


def _equal(name: str) -> Column:
    return (F.col(f"s_{name}") == F.col(f"t_{name}")) & (F.col(f"s_{name}") != "")


def _street_number(side: str) -> Column:
    from linkweave.functions.text import plain_number

    return plain_number(F.col(f"{side}_f_street"))


def _channel(c: int) -> Column:
    return _flag(F.expr(f"channel_mask & {1 << (c - 1)}") != 0)


def _count_difference(name: str) -> Column:
    return F.abs(F.size(f"s_{name}") - F.size(f"t_{name}"))


def ranker_features() -> dict[str, Column]:
    """The 29 features of the ranker, in order, before rounding to single precision."""
    name, address = _both(S.jaccard, "f_sig"), _both(S.jaccard, "f_atokens")
    exact, street, postal, country = _equal("n_alnum"), _equal("f_street"), _equal("f_postal"), _equal("country")
    return {
        "name_exact_match": _flag(exact),
        "name_token_jaccard": name,
        "name_token_containment": _both(S.containment, "f_sig"),
        "name_char2_sim": _both(S.jaccard, "f_char2"),
        "name_char3_sim": _both(S.jaccard, "f_char3"),
        "name_char4_sim": _both(S.jaccard, "f_char4"),
        "name_len_ratio": _both(S.length_ratio, "n_alnum"),
        "name_token_count_diff": _count_difference("f_tokens"),
        "addr_token_jaccard": address,
        "addr_token_containment": _both(S.containment, "f_atokens"),
        "addr_char3_sim": _both(S.jaccard, "f_achar3"),
        "addr_num_agreement": _flag(street),
        "addr_street_num_match": _flag(street),
        "addr_postal_match": _flag(postal),
        "addr_missing_s1": _flag(~F.col("s_f_has_address")),
        "addr_missing_t": _flag(~F.col("t_f_has_address")),
        "name_x_addr_sim": name.cast("float") * address.cast("float"),
        "exact_agreement_count": _flag(exact) + _flag(street) + _flag(postal) + _flag(country),
        "blocking_channel_hit_count": F.col("hits"),
        **{n: _channel(c) for c, n in enumerate(CHANNEL_FLAGS, 1)},
        "rare_token_score": S.rarity(F.col("rarest_token_df")),
        "is_transliteration_pair": _flag(F.col("s_f_non_latin") != F.col("t_f_non_latin")),
        "target_is_source3": _flag(F.col("tid").startswith("S3")),
    }


def matcher_features() -> dict[str, Column]:
    """The 52 features of the matcher, in order, before rounding to single precision.

    Thresholds inside them compare single-precision values.
    """
    name, address = _both(S.jaccard, "f_sig"), _both(S.jaccard, "f_atokens")
    name4, address4 = name.cast("float"), address.cast("float")
    f = lambda x: F.lit(x).cast("float")
    exact, same_address = _equal("n_alnum"), _equal("a_clean")
    street = (F.col("s_f_street") != "") & (_street_number("s") == _street_number("t"))
    postal, country = _equal("f_postal"), _equal("country")
    words = F.array_intersect("s_f_awords", "t_f_awords")
    return {
        "name_norm_exact_match": _flag(exact),
        "name_raw_exact_match": _flag(exact),
        "name_token_jaccard": name,
        "name_token_containment": _both(S.containment, "f_sig"),
        "name_char2_sim": _both(S.jaccard, "f_char2"),
        "name_char3_sim": _both(S.jaccard, "f_char3"),
        "name_char4_sim": _both(S.jaccard, "f_char4"),
        "name_edit_sim": _both(S.quick_edit_ratio, "n_alnum"),
        "name_len_ratio": _both(S.length_ratio, "n_alnum"),
        "name_token_count_diff": _count_difference("f_tokens"),
        "name_rare_token_overlap": S.rarity(F.col("rarest_token_df")),
        "name_shared_token_count": _both(S.shared, "f_sig"),
        "name_sig_token_overlap": name,
        "name_containment_s1_in_t": _both(S.directional, "f_sig"),
        "name_containment_t_in_s1": S.directional(F.col("t_f_sig"), F.col("s_f_sig")),
        "addr_norm_exact_match": _flag(same_address),
        "addr_token_jaccard": address,
        "addr_token_containment": _both(S.containment, "f_atokens"),
        "addr_char3_sim": _both(S.jaccard, "f_achar3"),
        "addr_numeric_overlap_count": _both(S.shared, "f_numbers"),
        "addr_numeric_jaccard": _both(S.jaccard, "f_numbers"),
        "addr_street_num_match": _flag(street),
        "addr_postal_match": _flag(postal),
        "addr_locality_overlap": _flag(_both(S.shared, "f_locality") > 0),
        "addr_region_overlap": _both(S.jaccard, "f_locality"),
        "addr_len_ratio": _both(S.length_ratio, "a_clean"),
        "addr_missing_s1": _flag(~F.col("s_f_has_address")),
        "addr_missing_t": _flag(~F.col("t_f_has_address")),
        "addr_shared_tokens_count": F.size(words),
        "addr_strongest_token_weight": F.coalesce(F.array_max(F.transform(words, lambda w: F.char_length(w))), F.lit(0)),
        "name_x_addr_sim": name4 * address4,
        "name_exact_addr_partial": _flag(exact & (address4 >= f(0.25))),
        "high_name_low_addr": _flag((name4 >= f(0.70)) & (address4 < f(0.20))),
        "low_name_high_addr": _flag((name4 < f(0.30)) & (address4 >= f(0.60))),
        "exact_numeric_low_name": _flag(street & (name4 < f(0.30))),
        "exact_addr_low_name": _flag(same_address & (name4 < f(0.30))),
        "field_consensus_count": _flag(exact) + _flag(same_address) + _flag(street) + _flag(postal) + _flag(country),
        "blocking_channel_hit_count": F.col("hits"),
        **{n: _channel(c) for c, n in enumerate(CHANNEL_FLAGS, 1)},
        "ch5_retrieval_score": F.col("ch5_score"),
        "candidate_ranker_score": F.col("ranker_score"),
        "candidate_ranker_rank": F.col("ranker_rank"),
        "candidate_ranker_reciprocal": 1 / F.greatest(F.lit(1), F.col("ranker_rank")),
        "target_is_source3": _flag(F.col("tid").startswith("S3")),
        "same_country": _flag(country),
        "is_transliteration_pair": _flag(F.col("s_f_non_latin") != F.col("t_f_non_latin")),
    }


def vectors(profiled: DataFrame, features: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Ids and the features in single precision."""
    return profiled.select(*(keep or ["s1_id", "tid"]), *[c.cast("float").alias(n) for n, c in features.items()])


#: Profile columns of the quick score.
QUICK = ["n_alnum", "f_sig", "f_tokens", "f_atokens", "f_numbers"]


def heuristic_scores(profiled: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, tid, hits, channel_mask, ``more`` and the quick score of each pair; score01 is a twelfth and a half of it."""
    tokens = lambda s: F.when(F.size(f"{s}_f_sig") > 0, F.col(f"{s}_f_sig")).otherwise(F.col(f"{s}_f_tokens"))
    score = S.heuristic(_equal("n_alnum"), S.jaccard(tokens("s"), tokens("t")), _both(S.shared, "f_numbers") > 0, _both(S.jaccard, "f_atokens"), F.col("hits"))
    return profiled.select("s1_id", "tid", "hits", "channel_mask", *more, F.round(score, 9).alias("score")).withColumn("score01", F.round(F.col("score") / 12.5, 9))
