"""Splits and negative samples by seeded hashes, the same each time and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.sources.paths import written

from . import taxonomy


def hashed(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


#: Buckets of the hash that a country is cut by: all but one of a country are decided by their number alone.
BUCKET_DIGITS = 3


def stratified_split(records: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(entity_id, country, part): about ``size`` validation records, each country by its share, the rest training.

    A country with over one record has at least one in each part.  Records are taken in
    order of a seeded hash of the id.  Counts by bucket of that hash say where the cut
    lies; only the rows of the bucket that it falls in are ordered.
    """
    hash_ = hashed(seed, "entity_id")
    df = records.select("entity_id", F.coalesce("country", F.lit("")).alias("_c"), "country", hash_.alias("_h")).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    buckets = written(df.groupBy("_c", "_b").agg(F.count("*").alias("_k")), "buckets")
    whole = Window.partitionBy("_c")  # at most a row a bucket
    upto = F.sum("_k").over(whole.orderBy("_b"))
    placed = buckets.withColumns({"_upto": upto, "_n": F.sum("_k").over(whole)}).join(F.broadcast(buckets.agg(F.sum("_k").alias("_all"))))  # one row
    quota = F.least(F.greatest(F.bround(size * F.col("_n") / F.col("_all"), 0), F.when(F.col("_n") > 1, 1).otherwise(0)), F.col("_n") - 1)
    cut = placed.withColumn("_quota", quota).filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_k") < F.col("_quota")))
    cuts = written(cut.select("_c", F.col("_b").alias("_cut"), (F.col("_quota") - F.col("_upto") + F.col("_k")).alias("_left")), "cuts")  # a row a country
    joined = df.join(cuts, "_c", "left")
    on_cut = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_h", "entity_id"))
    edge = joined.filter(on_cut).withColumn("_val", place <= F.col("_left"))
    rest = joined.filter(~on_cut).withColumn("_val", F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False)))
    return edge.unionByName(rest).select("entity_id", "country", F.when(F.col("_val"), "val").otherwise("train").alias("part"))


def negatives(labelled: DataFrame, per_positive: int, hard_share: float, hard: Column, keep_without_positives: bool, borrow: bool, seed: int = 42, more: tuple[str, ...] = ()) -> DataFrame:
    """(s1_id, tid, label, is_hard, ``more``): all positives and a sample of negatives for each record.

    ``labelled``: profiled pairs with label and hits.  The sample has ``per_positive``
    negatives a positive (a record without positives counts as having one, if it is
    kept), the share of hard ones rounded half to even; others fill the rest, and with
    ``borrow`` unused hard ones where others are scarce.
    """
    df = labelled.select("s1_id", "tid", "label", (hard & (F.col("label") == 0)).alias("is_hard"), *more)
    whole = Window.partitionBy("s1_id")
    kind = Window.partitionBy("s1_id", "label", "is_hard").orderBy(hashed(seed, "s1_id", "tid"), "tid")
    positives = F.sum("label").over(whole)
    df = df.withColumns({"_p": positives, "_n": F.row_number().over(kind), "_h": F.sum(F.col("is_hard").cast("int")).over(whole), "_o": F.sum(((F.col("label") == 0) & ~F.col("is_hard")).cast("int")).over(whole)})
    df = df.filter("_p > 0") if not keep_without_positives else df
    want = F.greatest(F.col("_p"), F.lit(1)) * per_positive
    df = df.withColumns({"_want": want, "_hard": F.least(F.col("_h"), F.bround(want * F.lit(hard_share), 0).cast("int"))})
    left = F.col("_want") - F.col("_hard")
    spare = F.greatest(left - F.col("_o"), F.lit(0)) if borrow else F.lit(0)
    take = (F.col("label") == 1) | (F.col("is_hard") & (F.col("_n") <= F.col("_hard") + spare)) | ((F.col("label") == 0) & ~F.col("is_hard") & (F.col("_n") <= left))
    return df.filter(take).select("s1_id", "tid", "label", "is_hard", *more)


def ranker_hard() -> Column:
    return taxonomy.is_hard(0.40, 0.20, 0.35, 0.20, 0.25)


def matcher_hard() -> Column:
    return taxonomy.is_hard(0.40, 0.25, 0.40, 0.25, 0.30)


def ranker_negatives(labelled: DataFrame, seed: int = 42, hard: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``hard``: which rows are hard, if ``labelled`` has no profiles."""
    return negatives(labelled, 8, 0.6, ranker_hard() if hard is None else hard, False, True, seed, more)


def matcher_negatives(labelled: DataFrame, seed: int = 42, hard: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    hard = matcher_hard() if hard is None else hard
    return negatives(labelled, 10, 0.7, hard | (F.col("ranker_score") >= 0.30) if "ranker_score" in labelled.columns else hard, True, False, seed, more)
