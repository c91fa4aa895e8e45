"""Rules that tables of results must keep: one row a broken rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.sources.records import id_list


def list_faults(results: DataFrame, column: str, s1: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, severity, id) for ``results(source1_entity_id, column)``; ``s1`` and ``known``: (entity_id)."""
    r = results.select(F.col("source1_entity_id").alias("s"), id_list(F.coalesce(F.col(column), F.lit(""))).alias("ids"))
    each = r.select("s", F.explode("ids").alias("t"))
    out = [
        r.groupBy("s").count().filter("count > 1").select(F.lit("repeated_row").alias("rule"), "s"),
        r.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.lit("repeated_target"), "s"),
        each.filter("s = t").select(F.lit("self_match"), "s"),
        each.filter(~F.col("t").rlike("^S[23]-")).select(F.lit("bad_prefix"), "t"),
        s1.select(F.col("entity_id").alias("s")).join(r, "s", "left_anti").select(F.lit("missing_record"), "s"),
        r.select("s").distinct().join(s1.select(F.col("entity_id").alias("s")), "s", "left_anti").select(F.lit("unknown_record"), "s"),
    ]
    if known is not None:
        out.append(each.join(known.select(F.col("entity_id").alias("t")), "t", "left_anti").select(F.lit("unknown_target"), "t"))
    faults = out[0]
    for x in out[1:]:
        faults = faults.union(x)
    return faults.select("rule", F.lit("error").alias("severity"), F.col("s").alias("id"))


def containment_faults(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates: a warning."""
    m = matches.select("source1_entity_id", F.explode(id_list(F.col("matched_entity_ids"))).alias("t"))
    c = candidates.select("source1_entity_id", F.explode(id_list(F.col("candidate_entity_ids"))).alias("t"))
    return m.join(c, ["source1_entity_id", "t"], "left_anti").select(F.lit("match_is_no_candidate").alias("rule"), F.lit("warning").alias("severity"), F.col("source1_entity_id").alias("id"))


def summary(faults: DataFrame) -> DataFrame:
    """(rule, severity, n, sample): how often each rule is broken, with the first id."""
    return faults.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.min("id").alias("sample"))
