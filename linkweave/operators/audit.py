"""The data audit as one long table of measures, for a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import percentile


def _long(wide: DataFrame, section: str, name: str) -> DataFrame:
    measures = [c for c in wide.columns if c != name]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    return wide.select(F.lit(section).alias("section"), F.col(name).alias("name"), each.alias("x")).select("section", "name", "x.*")


def audit(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(section, name, measure, value): sources, lengths of their fields, matches of S1 records, and countries.

    An id that is there n times counts as n - 1 repeated ones; a name or address of
    blanks alone counts as it is.
    """
    r = records.withColumns({"name": F.substring("entity_id", 1, 2), "l_name": F.char_length("business_name"), "l_address": F.char_length("business_address")})
    sources = r.groupBy("name").agg(
        F.count("*").alias("total_rows"), F.count_distinct("entity_id").alias("unique_ids"), F.count_if(F.col("business_name") == "").alias("empty_names"), F.count_if(F.col("business_address") == "").alias("empty_addresses"),
        *[f.alias(f"{what}_length_{n}") for what in ("name", "address") for n, f in (("min", F.min(f"l_{what}")), ("median", percentile(f"l_{what}", 0.5)), ("mean", F.round(F.avg(f"l_{what}"), 6)), ("p95", percentile(f"l_{what}", 0.95)), ("max", F.max(f"l_{what}")))],
    ).withColumn("duplicate_ids", F.col("total_rows") - F.col("unique_ids"))
    n = truth.groupBy("s1_id").agg(F.count("*").alias("n"), F.count_if(F.col("tid").startswith("S2-")).alias("n2"), F.count_if(F.col("tid").startswith("S3-")).alias("n3"))
    s1 = records.filter(F.col("entity_id").startswith("S1-")).select(F.col("entity_id").alias("s1_id"), "country").join(n, "s1_id", "left").na.fill(0, ["n", "n2", "n3"])
    counts = [F.count("*").alias("total_s1"), F.count_if(F.col("n") == 0).alias("singletons"), F.sum("n").alias("total_matches"), F.round(F.avg("n"), 6).alias("mean_matches")]
    whole = s1.agg(*counts, F.count_if((F.col("n2") > 0) & (F.col("n3") == 0)).alias("s2_only"), F.count_if((F.col("n3") > 0) & (F.col("n2") == 0)).alias("s3_only"), F.count_if((F.col("n2") > 0) & (F.col("n3") > 0)).alias("both_s2_and_s3"), *[percentile("n", q / 100).alias(f"p{q}_matches") for q in (25, 50, 75, 95, 99)], F.max("n").alias("max_matches")).withColumn("name", F.lit("all"))
    countries = s1.groupBy(F.col("country").alias("name")).agg(*counts)
    return _long(sources, "sources", "name").unionByName(_long(whole, "ground_truth", "name")).unionByName(_long(countries, "countries", "name"))
