"""True pairs that exact channels miss: categories, the table of examples, and similarities of names.

All work on profiled true pairs (columns s_* and t_*, with ch1 to ch4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import similarity as S

from . import features as FE
from . import taxonomy as TX
from .evaluation import mean, percentile

#: Exact channels of a baseline: name and key column.
BASELINE = {"ch1_core_name": "ch1", "ch2_top2_tokens": "ch2", "ch3_street_num_token": "ch3", "ch4_address_location": "ch4"}
#: Profile columns that this module reads beside those of the taxonomies.
COLUMNS = [*TX.COLUMNS, "a_tokens", "a_numbers", "n_tokens", "ch1", "ch2", "ch3", "ch4"]
#: Examples of a category in the table.
EXAMPLES = 120
# The columns of the published table, in their order.
MISSED_COLUMNS = [
    "failure_category", "s1_id", "s1_country", "s1_name", "s1_address", "target_id", "target_source", "target_name", "target_address",
    "norm_s1_name", "norm_target_name", "norm_s1_address", "norm_target_address", "failed_blocking_channels", "s1_has_address", "target_has_address",
    "s1_numeric_tokens", "target_numeric_tokens", "s1_name_token_count", "target_name_token_count", "s1_name_char_len", "target_name_char_len",
]


def failed_channels(channels: dict[str, str] = BASELINE) -> Column:
    """Names of the channels whose keys do not find the pair."""
    each = [F.when(~((F.col(f"s_{k}") != "") & (F.col(f"s_{k}") == F.col(f"t_{k}"))), F.lit(n)) for n, k in channels.items()]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def is_missed(channels: dict[str, str] = BASELINE) -> Column:
    return F.size(failed_channels(channels)) == len(channels)


def category() -> Column:
    """Why a baseline missed a pair, by the labels of its report."""
    s, t = F.col("s_n_sig"), F.col("t_n_sig")
    overlap = S.shared(F.col("s_f_tokens"), F.col("t_f_tokens"))
    return (
        F.when(~F.col("t_f_has_address"), "missing_target_address")
        .when(F.col("t_f_non_latin") & ~F.col("s_f_non_latin"), "transliteration")
        .when((F.size(s) > 0) & (s == t), "legal_suffix")
        .when((F.size(s) > 0) & (F.array_sort(s) == F.array_sort(t)), "word_order")
        .when((F.size("s_f_numbers") > 0) & (F.size("t_f_numbers") == 0), "missing_street_number")
        .when((overlap == 0) & (S.jaccard(F.col("s_f_atokens"), F.col("t_f_atokens")) >= 0.25), "trade_name_or_dba")
        .when(overlap > 0, "name_typo_or_abbreviation")
        .otherwise("unknown")
    )


def categories(pairs: DataFrame, channels: dict[str, str] = BASELINE) -> DataFrame:
    """(category, n, and how many each configuration would find) of the missed ``pairs``."""
    missed = pairs.filter(is_missed(channels))
    return missed.groupBy(category().alias("category")).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"found_by_{n}") for n, c in TX.theory().items()])


def examples(pairs: DataFrame, channels: dict[str, str] = BASELINE, n: int = EXAMPLES) -> DataFrame:
    """MISSED_COLUMNS of the first ``n`` missed pairs of each category, by ids."""
    first = F.row_number().over(Window.partitionBy("failure_category").orderBy("s1_id", "tid"))
    missed = pairs.filter(is_missed(channels)).withColumn("failure_category", category()).withColumn("_n", first).filter(F.col("_n") <= n)
    name = lambda s: F.when(F.size(f"{s}_n_sig") > 0, F.array_join(f"{s}_n_sig", " ")).otherwise(F.col(f"{s}_n_alnum"))
    made = {
        "s1_country": F.col("s_country"), "s1_name": F.col("s_business_name"), "s1_address": F.col("s_business_address"), "target_id": F.col("tid"),
        "target_source": F.substring("tid", 1, 2), "target_name": F.col("t_business_name"), "target_address": F.col("t_business_address"),
        "norm_s1_name": name("s"), "norm_target_name": name("t"), "norm_s1_address": F.col("s_a_clean"), "norm_target_address": F.col("t_a_clean"),
        "failed_blocking_channels": F.array_join(failed_channels(channels), "; "), "s1_has_address": F.col("s_f_has_address"), "target_has_address": F.col("t_f_has_address"),
        "s1_numeric_tokens": F.array_join("s_a_numbers", "; "), "target_numeric_tokens": F.array_join("t_a_numbers", "; "),
        "s1_name_token_count": F.size("s_n_tokens"), "target_name_token_count": F.size("t_n_tokens"), "s1_name_char_len": F.char_length("s_business_name"), "target_name_char_len": F.char_length("t_business_name"),
    }
    return missed.select("failure_category", "s1_id", *[c.alias(k) for k, c in made.items()]).select(*MISSED_COLUMNS)


def name_similarities() -> dict[str, Column]:
    """Ten measures of how alike two names are, rounded, so that a group has a bounded number of values."""
    both = lambda f, c: f(F.col(f"s_{c}"), F.col(f"t_{c}"))
    empty = (F.col("s_n_alnum") == "") & (F.col("t_n_alnum") == "")
    or_one = lambda c: F.when(empty, F.lit(1.0)).otherwise(c)
    n = S.shared(F.col("s_f_tokens"), F.col("t_f_tokens"))
    some = (F.size("s_f_tokens") > 0) & (F.size("t_f_tokens") > 0)
    made = {
        "exact_name_equality": F.when((F.col("s_n_alnum") == F.col("t_n_alnum")) & (F.col("s_n_alnum") != ""), 1.0).otherwise(0.0),
        "token_jaccard": both(S.jaccard, "f_tokens"),
        "char_2gram_overlap": both(S.jaccard, "f_char2"),
        "char_3gram_overlap": both(S.jaccard, "f_char3"),
        "char_4gram_overlap": both(S.jaccard, "f_char4"),
        "edit_similarity": both(S.edit_ratio, "n_alnum"),
        "prefix_overlap": or_one(both(S.common_prefix, "n_alnum")),
        "suffix_overlap": or_one(both(S.common_suffix, "n_alnum")),
        "length_ratio": or_one(both(S.length_ratio, "n_alnum")),
        "token_containment": F.when(some & ((n == F.size("s_f_tokens")) | (n == F.size("t_f_tokens"))), 1.0).otherwise(0.0),
    }
    return {k: F.round(v.cast("double"), 6) for k, v in made.items()}


def name_similarity_summary(pairs: DataFrame, channels: dict[str, str] = BASELINE) -> DataFrame:
    """(pairs, metric, n, mean, p25, p50, p75, p90, p95) of missed pairs, those with an empty address, and found ones."""
    missed = is_missed(channels)
    groups = F.when(~missed, F.array(F.lit("correctly_blocked_matches"))).when(F.col("t_f_has_address"), F.array(F.lit("all_missed_pairs"))).otherwise(F.array(F.lit("all_missed_pairs"), F.lit("missed_empty_target_address")))
    values = F.array(*[F.named_struct(F.lit("metric"), F.lit(k), F.lit("v"), v) for k, v in name_similarities().items()])
    each = pairs.select(F.explode(groups).alias("pairs"), values.alias("x")).select("pairs", F.explode("x").alias("x")).select("pairs", "x.*")
    return each.groupBy("pairs", "metric").agg(F.count("*").alias("n"), mean("v").alias("mean"), *[percentile("v", q / 100).alias(f"p{q}") for q in (25, 50, 75, 90, 95)])


def feature_means(kept: DataFrame, lost: DataFrame, hard: DataFrame) -> DataFrame:
    """(pairs, n, and the mean of each ranker feature) of profiled pairs that a ranking kept, lost, and hard negatives.

    Features are of the two records alone, without where the pair was found; a group
    without pairs has zeros.
    """
    made = FE.ranker_features()
    bare = {"hits": F.lit(0), "channel_mask": F.lit(0), "rarest_token_df": F.lit(0)}
    spark = kept.sparkSession
    names = ("retained_true_positives", "missed_false_negatives", "hard_negatives")
    parts = [FE.vectors(df.withColumns(bare), made, ["s1_id", "tid"]).withColumn("pairs", F.lit(n)) for df, n in zip((kept, lost, hard), names, strict=True)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("pairs").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in made])
    return spark.createDataFrame([(n,) for n in names], "pairs string").join(found, "pairs", "left").na.fill(0)
