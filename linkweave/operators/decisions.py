"""Which of a record's candidates are matches, and who gets a target that several claim.

All take ``scored(s1_id, tid, score)``, and return (s1_id, tid, score, rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

THRESHOLD, MARGIN, SINGLETON = 0.70, 0.10, 0.50
STRATEGIES = ("global_threshold", "top_1_or_none", "threshold_and_margin", "score_drop_elbow", "adaptive_relative")


def decide(scored: DataFrame, strategy: str = "threshold_and_margin", threshold: float = THRESHOLD, margin: float = MARGIN, singleton: float = SINGLETON, cap: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Matches by the engine's rule: none, unless the best score reaches ``threshold`` and ``singleton``.

    ``threshold`` and ``margin`` may be names of columns, which are then the same in all
    rows of a record and ``keys``.
    """
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    th, mg = value(threshold), value(margin)
    group = Window.partitionBy("s1_id", *keys)
    order = group.orderBy(F.desc("score"), "tid")
    df = scored.withColumns({"rank": F.row_number().over(order), "_top": F.max("score").over(group)})
    df = df.filter((F.col("_top") >= singleton) & (F.col("_top") >= th))
    if strategy == "global_threshold":
        df = df.filter(F.col("score") >= th)
    elif strategy == "top_1_or_none":
        df = df.filter(F.col("rank") == 1)
    elif strategy == "threshold_and_margin":
        df = df.filter(F.col("score") >= F.greatest(th, F.col("_top") - mg))
    elif strategy == "adaptive_relative":
        df = df.filter(F.col("score") >= F.greatest(th, F.col("_top") * (1.0 - mg)))
    elif strategy == "score_drop_elbow":
        drop = F.coalesce(F.lag("score").over(order) - F.col("score") > mg, F.lit(False)) | (F.col("score") < th)
        df = df.withColumn("_drop", drop.cast("int")).withColumn("_drops", F.sum("_drop").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_drops = 0").drop("_drop", "_drops")
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    if cap is not None:
        df = df.filter(F.col("rank") <= cap)
    return df.drop("_top")


def decide_by_first_ranked(scored: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """The rule of production: what counts is the score of the candidate that the ranker put first (``ranker_rank``)."""
    first = F.first("score").over(Window.partitionBy("s1_id").orderBy("ranker_rank", "tid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = scored.withColumn("_first", first).filter((F.col("_first") >= threshold) & (F.col("score") >= F.greatest(F.lit(threshold), F.col("_first") - margin)))
    return ranked(kept.drop("_first"))


def with_all_records(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """(s1_id, tid) with a row of null tid for each record without a match."""
    return s1.select(F.col("entity_id").alias("s1_id")).join(matches.select("s1_id", "tid"), "s1_id", "left")


def one_to_one(claims: DataFrame, least: float = 0.0) -> DataFrame:
    """Each target goes to the claim with the best score of ``least`` or more; ties to the smaller record."""
    n = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("score"), "s1_id"))
    return claims.filter(F.col("score") >= least).withColumn("_n", n).filter("_n = 1").drop("_n")


def conflicts(claims: DataFrame) -> DataFrame:
    """(tid, claims) of targets that more than one record claims."""
    return claims.groupBy("tid").agg(F.count("*").alias("claims")).filter("claims > 1")
