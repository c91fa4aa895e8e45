"""Evaluation: entity scores, candidate recall, attribution, curves, calibration, breakdowns.

``truth`` and ``pairs`` are (s1_id, tid) tables, ``s1`` is (s1_id).  Records without a
match count: every measure starts from ``s1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.sources.paths import written

from .blocking import CHANNELS

BETA2 = 0.25
BUDGETS = [10, 15, 25, 40, 60, 100]
RECALL_KS = [10, 15, 25, 40, 60, 80, 100, 150, 200]


def percentile(column: str, p: float) -> Column:
    """Exact, rounded; a group's task holds its distinct values, so give it counts, or shares of few digits."""
    return F.round(F.expr(f"percentile({column}, {p})"), 6)


def counts(s1: DataFrame, truth: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, s1_id, n_true, n_pred, n_both) of each record; ``pairs`` may have ``keys``, and so must ``s1`` then."""
    marked = truth.withColumn("_true", F.lit(1))
    both = pairs.select(*keys, "s1_id", "tid").join(marked, ["s1_id", "tid"], "left")
    p = both.groupBy(*keys, "s1_id").agg(F.count("tid").alias("n_pred"), F.count("_true").alias("n_both"))
    t = truth.groupBy("s1_id").agg(F.count("tid").alias("n_true"))
    return s1.select(*keys, "s1_id").join(t, "s1_id", "left").join(p, [*keys, "s1_id"], "left").na.fill(0, ["n_true", "n_pred", "n_both"])


def scores(counted: DataFrame) -> DataFrame:
    """precision, recall and f05 of each record; both sets empty: 1, one of them: 0."""
    t, p, b = F.col("n_true"), F.col("n_pred"), F.col("n_both")
    empty = (t == 0) & (p == 0)
    precision = F.when(empty, 1.0).when((p == 0) | (t == 0), 0.0).otherwise(b / p)
    recall = F.when(empty, 1.0).when((p == 0) | (t == 0), 0.0).otherwise(b / t)
    f = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise((1 + BETA2) * F.col("precision") * F.col("recall") / (BETA2 * F.col("precision") + F.col("recall")))
    return counted.withColumns({"precision": precision, "recall": recall}).withColumn("f05", f)


def mean(c: str) -> Column:
    return F.round(F.avg(c), 6)


def macro(s: DataFrame, *keys: str) -> DataFrame:
    return s.groupBy(*keys).agg(F.count("*").alias("entities"), mean("f05").alias("macro_f05"), mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"))


def detailed(s: DataFrame, *keys: str) -> DataFrame:
    """Macro measures, singletons, totals and the distribution of f05."""
    single = F.col("n_true") == 0
    right = single & (F.col("n_pred") == 0)
    return s.groupBy(*keys).agg(
        F.count("*").alias("entities"), mean("f05").alias("macro_f05"), mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"),
        F.count_if(single).alias("singletons"), F.count_if(right).alias("singletons_right"), F.round(F.count_if(right) / F.greatest(F.lit(1), F.count_if(single)), 6).alias("singleton_accuracy"),
        F.sum("n_both").alias("tp"), F.sum(F.col("n_pred") - F.col("n_both")).alias("fp"), F.sum(F.col("n_true") - F.col("n_both")).alias("fn"),
        percentile("f05", 0.25).alias("f05_p25"), percentile("f05", 0.5).alias("f05_median"), F.count_if(F.col("f05") == 1).alias("f05_perfect"), F.count_if(F.col("f05") == 0).alias("f05_zero"),
    )


def candidate_recall(counted: DataFrame, *keys: str) -> DataFrame:
    """Recall of candidates, coverage of records with matches, and candidate set sizes."""
    has, full = F.col("n_true") > 0, F.col("n_both") == F.col("n_true")
    total, got = F.sum("n_true"), F.sum("n_both")
    return counted.groupBy(*keys).agg(
        F.round(F.when(total > 0, got / total).otherwise(1.0), 6).alias("candidate_recall"), total.alias("true_matches"), got.alias("captured"), (total - got).alias("missed"),
        F.count_if(has & full).alias("full_coverage"), F.count_if(has & ~full & (F.col("n_both") > 0)).alias("partial_coverage"), F.count_if(has & (F.col("n_both") == 0)).alias("zero_coverage"),
        mean("n_pred").alias("size_mean"), percentile("n_pred", 0.5).alias("size_median"), percentile("n_pred", 0.9).alias("size_p90"), percentile("n_pred", 0.95).alias("size_p95"), percentile("n_pred", 0.99).alias("size_p99"), F.max("n_pred").alias("size_max"),
    )


def channel_sets(candidates: DataFrame) -> DataFrame:
    """(channel, s1_id, tid): candidates once for each channel that found them."""
    each = F.explode(F.array(*[F.when(F.col("channel_mask").bitwiseAND(F.lit(1 << (c - 1))) != 0, F.lit(c)) for c in CHANNELS]))
    return candidates.select(each.alias("channel"), "s1_id", "tid").filter("channel is not null")


def attribution(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each channel the true matches it finds, those only it finds, those of it and the channels before, and the gain."""
    hit = truth.join(candidates.select("s1_id", "tid", "channel_mask"), ["s1_id", "tid"], "left").select(F.coalesce("channel_mask", F.lit(0)).alias("m"))
    one = hit.agg(F.count("*").alias("total"), *[F.count_if(F.col("m").bitwiseAND(F.lit(1 << (c - 1))) != 0).alias(f"found{c}") for c in CHANNELS], *[F.count_if(F.col("m") == (1 << (c - 1))).alias(f"only{c}") for c in CHANNELS], *[F.count_if(F.col("m").bitwiseAND(F.lit((1 << c) - 1)) != 0).alias(f"upto{c}") for c in CHANNELS])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"found{c}").alias("found"), F.col(f"only{c}").alias("exclusive"), F.col(f"upto{c}").alias("cumulative"), (F.col(f"upto{c}") - (F.col(f"upto{c - 1}") if c > 1 else F.lit(0))).alias("incremental")) for c in CHANNELS]))
    r = lambda x: F.round(F.when(F.col("total") > 0, F.col(x) / F.col("total")).otherwise(0.0), 6)
    return one.select("total", rows.alias("x")).select("x.*", "total").select("channel", "found", "exclusive", "cumulative", "incremental", r("exclusive").alias("exclusive_recall"), r("cumulative").alias("cumulative_recall"), r("incremental").alias("incremental_recall"))


def budgets(s1: DataFrame, truth: DataFrame, ranking: DataFrame, ks: list[int]) -> DataFrame:
    """For each K: recall of the first K candidates, lost matches, truncated records and sizes; one ranking, one pass."""
    marked = ranking.join(truth.withColumn("_true", F.lit(1)), ["s1_id", "tid"], "left")
    each = marked.groupBy("s1_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks], F.count("_true").alias("b"), *[F.count_if((F.col("rank") <= k) & F.col("_true").isNotNull()).alias(f"b{k}") for k in ks])
    t = truth.groupBy("s1_id").agg(F.count("tid").alias("t"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("size"), F.col(f"b{k}").alias("got")) for k in ks]))
    all_ = s1.select("s1_id").join(each, "s1_id", "left").join(t, "s1_id", "left").na.fill(0)
    flat = all_.select("n", "t", "b", rows.alias("x")).select("x.k", "x.size", "x.got", "n", "t", "b")
    return flat.groupBy("k").agg(F.round(F.sum("got") / F.greatest(F.lit(1), F.sum("t")), 6).alias("recall"), F.sum("got").alias("captured"), (F.sum("b") - F.sum("got")).alias("lost"), F.count_if(F.col("n") > F.col("k")).alias("truncated"), mean("size").alias("mean_size"), percentile("size", 0.5).alias("median_size"), percentile("size", 0.95).alias("p95_size"), F.sum("size").alias("total_size"))


def curves(labelled: DataFrame, parts: int = 256) -> DataFrame:
    """(pr_auc, average_precision, roc_auc) of ``labelled(label, score)``; 0 if only one class is there.

    Rows of equal score are one point.  Points are cut in ``parts`` by approximate
    quantiles of the scores; sums run within a part, and over the parts' totals.
    """
    points = written(labelled.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")), "points")
    cuts = points.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 10_000).alias("cuts"))  # one row
    placed = points.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c > F.col("score")))).drop("cuts")
    totals = placed.groupBy("part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    whole, before = Window.partitionBy(), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    totals = totals.select("part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("p_before"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n_before"), F.sum("_p").over(whole).alias("all_p"), F.sum("_n").over(whole).alias("all_n"))
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    c = placed.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)}).join(F.broadcast(totals), "part")
    c = c.withColumns({"tp": F.col("tp") + F.col("p_before"), "fp": F.col("fp") + F.col("n_before")}).withColumns({"_tp": F.col("tp") - F.col("p"), "_fp": F.col("fp") - F.col("n")})
    step = F.col("p") / F.col("all_p")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    last = F.when(F.col("_tp") + F.col("_fp") > 0, F.col("_tp") / (F.col("_tp") + F.col("_fp"))).otherwise(1.0)
    both = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    value = lambda x: F.round(F.coalesce(F.when(both, x), F.lit(0.0)), 6)
    return c.agg(value(F.sum(step * (precision + last) / 2)).alias("pr_auc"), value(F.sum(step * precision)).alias("average_precision"), value(F.sum(F.col("n") * (F.col("tp") + F.col("_tp")) / 2) / F.max(F.col("all_p") * F.col("all_n"))).alias("roc_auc"))


def calibration_bins(labelled: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_pred, positive_rate, error) of all bins of equal width; the last is closed."""
    spark = labelled.sparkSession
    own = labelled.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.avg("label").alias("r"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(own, "bin", "left")
    m, r = F.coalesce("m", (F.col("bin") + 0.5) / bins), F.coalesce("r", F.lit(0.0))
    return every.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(m, 6).alias("mean_pred"), F.round(r, 6).alias("positive_rate"), F.round(F.abs(m - r), 6).alias("error"))


def calibration(labelled: DataFrame, bins: int = 10) -> DataFrame:
    """(brier, log_loss, ece) of ``labelled(label, score)``."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))
    per_bin = labelled.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))).groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("score") - F.avg("label")).alias("e"), F.sum((F.col("score") - F.col("label")) ** 2).alias("b"), F.sum(loss).alias("l"))
    n = F.sum("n")
    return per_bin.agg(F.round(F.sum("b") / n, 6).alias("brier"), F.round(F.sum("l") / n, 6).alias("log_loss"), F.round(F.sum(F.col("n") * F.col("e")) / n, 6).alias("ece"))


def singleton_diagnostics(s1: DataFrame, truth: DataFrame, scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best scores of records with and without matches; none counts as 0."""
    top = scored.groupBy("s1_id").agg(F.max("score").alias("top"))
    t = truth.groupBy("s1_id").agg(F.count("*").alias("n"))
    each = s1.select("s1_id").join(t, "s1_id", "left").join(top, "s1_id", "left").na.fill(0)
    single = F.col("n") == 0
    right = F.count_if(single & (F.col("top") < threshold))
    return each.agg(F.count_if(single).alias("singletons"), right.alias("predicted_empty"), F.round(right / F.greatest(F.lit(1), F.count_if(single)), 6).alias("singleton_accuracy"), F.count_if(single & (F.col("top") >= threshold)).alias("false_merges"), F.round(F.coalesce(F.avg(F.when(single, F.col("top"))), F.lit(0.0)), 6).alias("singleton_mean_top"), F.round(F.coalesce(F.avg(F.when(~single, F.col("top"))), F.lit(0.0)), 6).alias("other_mean_top"))


def by_cardinality(s: DataFrame) -> DataFrame:
    """Measures by the number of true matches: 0 to 6, and 7 or more."""
    return macro(s.withColumn("cardinality", F.when(F.col("n_true") >= 7, "7+").otherwise(F.col("n_true").cast("string"))), "cardinality")


def confusion(s: DataFrame) -> DataFrame:
    """Records by true (rows) and predicted (columns p0 to p4) number of matches; 4: four or more."""
    bin_ = lambda c: F.least(F.col(c), F.lit(4)).cast("int")
    return s.select(bin_("n_true").alias("true_bin"), F.concat(F.lit("p"), bin_("n_pred")).alias("p")).groupBy("true_bin").pivot("p", [f"p{i}" for i in range(5)]).count().na.fill(0)


def pair_outcomes(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, tid, outcome): tp, fp or fn."""
    t = truth.select("s1_id", "tid", F.lit(1).alias("_t"))
    p = pairs.select("s1_id", "tid", F.lit(1).alias("_p"))
    return t.join(p, ["s1_id", "tid"], "full").select("s1_id", "tid", F.when(F.col("_t").isNull(), "fp").when(F.col("_p").isNull(), "fn").otherwise("tp").alias("outcome"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shared, only_a, only_b, records) of two sets of pairs; records: those in which they differ."""
    o = pair_outcomes(a, b)
    return o.agg(F.count_if(F.col("outcome") == "tp").alias("shared"), F.count_if(F.col("outcome") == "fn").alias("only_a"), F.count_if(F.col("outcome") == "fp").alias("only_b"), F.count_distinct(F.when(F.col("outcome") != "tp", F.col("s1_id"))).alias("records"))


def conflict_audit(truth: DataFrame, claims: DataFrame, kept: DataFrame) -> DataFrame:
    """What giving each target to one record removed."""
    marked = claims.select("s1_id", "tid").join(kept.select("s1_id", "tid", F.lit(1).alias("_kept")), ["s1_id", "tid"], "left").join(truth.select("s1_id", "tid", F.lit(1).alias("_true")), ["s1_id", "tid"], "left")
    per_target = marked.groupBy("tid").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("conflicted"), F.sum("n").alias("claims"))
    gone = F.col("_kept").isNull()
    per_record = marked.groupBy("s1_id").agg(F.count_if(gone).alias("gone"), F.count_if(gone & F.col("_true").isNotNull()).alias("gone_true"), F.count("_kept").alias("kept"))
    sums = per_record.agg(F.sum("gone").alias("removed"), F.sum("gone_true").alias("removed_true"), (F.sum("gone") - F.sum("gone_true")).alias("removed_false"), F.count_if(F.col("gone") > 0).alias("affected"), F.count_if((F.col("gone") > 0) & (F.col("kept") == 0)).alias("emptied"))
    return per_target.join(F.broadcast(sums))  # a row each
