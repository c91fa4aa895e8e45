"""Ranking of candidates and the policies that cut the ranking.

All take ``scored(s1_id, tid, score[, hits])`` and keep whole rows with ``rank``; ties
go to the smaller tid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "tid")))


def fixed(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.filter(F.col("rank") <= k)


def pruned(scored: DataFrame, k: int = 25) -> DataFrame:
    """All, if a record has at most ``k``; else the first ``k``: the same filter."""
    return fixed(ranked(scored), k)


def above(ranking: DataFrame, threshold: float, least: int = 0, most: int = 1 << 30) -> DataFrame:
    """Scores of the threshold and above, filled up to ``least`` and cut at ``most``; never none."""
    keep = (F.col("score") >= threshold) | (F.col("rank") <= max(least, 1))
    return ranking.filter(keep & (F.col("rank") <= max(most, 1)))


def near_top(ranking: DataFrame, ratio: float, least: int = 0, most: int = 1 << 30) -> DataFrame:
    """Scores of ``ratio`` times the best and above, filled up to ``least`` and cut at ``most``."""
    top = F.max("score").over(Window.partitionBy("s1_id"))
    return ranking.withColumn("_top", top).filter(((F.col("score") >= F.col("_top") * ratio) | (F.col("rank") <= least)) & (F.col("rank") <= most)).drop("_top")


def by_evidence(ranking: DataFrame, k: int, most: int = 1 << 30) -> DataFrame:
    """Pairs of two channels or more first, ``most`` at most; then others by rank up to ``k``.

    The first of all is looked at even when the ``k`` are there: it is added if it has
    one channel.
    """
    whole = Window.partitionBy("s1_id")
    multi = (F.col("hits") >= 2).cast("int")
    in_kind = F.row_number().over(Window.partitionBy("s1_id", "_multi").orderBy("rank"))
    df = ranking.withColumn("_multi", multi).withColumn("_n", in_kind)
    df = df.withColumn("_firm", F.least(F.sum("_multi").over(whole), F.lit(most)))
    # Rows beyond the first kind's cut count as others, in order of rank.
    firm = (F.col("_multi") == 1) & (F.col("_n") <= F.col("_firm"))
    df = df.withColumn("_other", F.sum((~firm).cast("int")).over(whole.orderBy("rank")))
    fill = ~firm & ((F.col("_firm") + F.col("_other") <= k) | ((F.col("rank") == 1) & (F.col("_firm") >= k)))
    return df.filter(firm | fill).drop("_multi", "_n", "_firm", "_other")
