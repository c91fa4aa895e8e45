"""Search for the decision rule with the best macro score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.sources.paths import written

from . import decisions as D
from . import evaluation as E

THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]
MARGINS = [0.10, 0.15, 0.20, 0.25, 0.30]
FOCUS = 5
OTHERS = ("threshold_and_margin", "score_drop_elbow", "adaptive_relative")


def sorted_claims(s1: DataFrame, truth: DataFrame, claims: DataFrame) -> DataFrame:
    """(s1_id, n_true, claims): each record's (score, hit) from the best on; a record has as many as its budget at most."""
    hit = claims.select("s1_id", "tid", "score").join(truth.select("s1_id", "tid", F.lit(True).alias("hit")), ["s1_id", "tid"], "left")
    lists = hit.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "tid", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("x"))
    own = F.transform(F.coalesce("x", F.array().cast("array<struct<less:double,tid:string,hit:boolean>>")), lambda c: F.struct((-c["less"]).alias("score"), c["hit"].alias("hit")))
    n = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    return s1.select("s1_id").join(n, "s1_id", "left").join(lists, "s1_id", "left").select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"), own.alias("claims"))


def taken(strategy: str, threshold: float, margin: float) -> Column:
    """The first of ``claims`` that a rule takes, as an array: every rule takes some from the best on."""
    c, th = F.col("claims"), F.lit(threshold)
    top = F.get(c, F.lit(0))["score"]
    if strategy == "global_threshold":
        found = F.filter(c, lambda x: x["score"] >= th)
    elif strategy == "threshold_and_margin":
        found = F.filter(c, lambda x: x["score"] >= F.greatest(th, top - F.lit(margin)))
    elif strategy == "adaptive_relative":
        found = F.filter(c, lambda x: x["score"] >= F.greatest(th, top * F.lit(1.0 - margin)))
    else:  # up to the first that is low, or far below the one before
        ends = F.filter(F.transform(c, lambda x, i: F.when((x["score"] < th) | F.coalesce(F.get(c, i - 1)["score"] - x["score"] > F.lit(margin), F.lit(False)), i)), lambda i: i.isNotNull())
        found = F.slice(c, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.size(c)))
    open_ = F.coalesce((top >= D.SINGLETON) & (top >= th), F.lit(False))
    return F.when(open_, found).otherwise(F.slice(c, 1, 0))


def evaluated(records: DataFrame, grid: list[tuple[str, float, float]]) -> DataFrame:
    """(strategy, threshold, margin, macro_f05) of all settings, each decided once a record of ``sorted_claims``."""
    outcome = lambda s, t, m: F.struct(F.lit(s).alias("strategy"), F.lit(t).alias("threshold"), F.lit(m).alias("margin"), F.size(taken(s, t, m)).alias("n_pred"), F.size(F.filter(taken(s, t, m), lambda x: x["hit"])).alias("n_both"))
    each = records.select("n_true", F.explode(F.array(*[outcome(*x) for x in grid])).alias("x")).select("n_true", "x.*")
    return E.scores(each).groupBy("strategy", "threshold", "margin").agg(E.mean("f05").alias("macro_f05"))


def best_rule(s1: DataFrame, truth: DataFrame, claims: DataFrame) -> DataFrame:
    """All settings tried, best first: every threshold alone, then margins with the FOCUS best of them."""
    records = written(sorted_claims(s1, truth, claims), "sorted-claims")
    alone = written(evaluated(records, [("global_threshold", t, 0.0) for t in THRESHOLDS]), "alone")
    focus = [r[0] for r in alone.orderBy(F.desc("macro_f05"), "threshold").limit(FOCUS).select("threshold").collect()]
    out = alone.unionByName(evaluated(records, [(s, t, m) for s in OTHERS for t in focus for m in MARGINS]))
    return out.orderBy(F.desc("macro_f05"), "strategy", "threshold", "margin")
