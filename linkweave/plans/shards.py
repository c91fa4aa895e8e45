"""Linking in shards that can be resumed: each is there whole, with a manifest, or not at all.

A shard is a share of the S1 records, dealt by a hash of their ids; all targets are in
its index, so its result does not depend on the other shards.  Candidates and claims are
written by Spark's commit protocol; the manifest, last, names the configuration.  A run
skips the shards whose manifest has the hash of its own configuration.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.keys import with_profiles
from linkweave.operators import decisions
from linkweave.operators.models import PairModel
from linkweave.sources.paths import written
from linkweave.sources.records import of_source

from .link import LinkConfig, matcher_scores, ranked_candidates

MANIFEST = "shard int, config_hash string, records long, candidates long, claims long"


def config_hash(config: LinkConfig, shards: int) -> str:
    return hashlib.sha256(json.dumps([asdict(config), shards], sort_keys=True).encode()).hexdigest()


def _manifest(spark: SparkSession, folder: str) -> list[dict]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    return [r.asDict() for r in spark.read.schema(MANIFEST).json(f"{folder}/manifest").collect()]  # one row


def run_shards(records: DataFrame, root: str, shards: int, config: LinkConfig = LinkConfig(), ranker: PairModel | None = None, matcher: PairModel | None = None) -> list[int]:
    """Make what is not there yet; returns the numbers of the shards that were made."""
    spark, wanted = records.sparkSession, config_hash(config, shards)
    open_ = [s for s in range(shards) if not any(m["config_hash"] == wanted for m in _manifest(spark, f"{root}/shard={s}"))]
    if not open_:
        return []
    profiles = written(with_profiles(records), "profiles")
    targets = of_source(profiles, "S2", "S3")
    for s in open_:
        queries = of_source(profiles, "S1").filter(F.pmod(F.xxhash64("entity_id"), F.lit(shards)) == s)
        folder = f"{root}/shard={s}"
        ranked_candidates(queries, targets, config, ranker).write.mode("overwrite").parquet(f"{folder}/candidates")
        chosen = spark.read.parquet(f"{folder}/candidates")
        scored = matcher_scores(queries, targets, chosen, matcher)
        decisions.decide(scored, config.strategy, config.threshold, config.margin).write.mode("overwrite").parquet(f"{folder}/claims")
        count = lambda df: df.agg(F.count("*").alias("n"))
        row = count(queries).select(F.lit(s).alias("shard"), F.lit(wanted).alias("config_hash"), F.col("n").alias("records")).join(F.broadcast(count(chosen).withColumnRenamed("n", "candidates"))).join(F.broadcast(count(spark.read.parquet(f"{folder}/claims")).withColumnRenamed("n", "claims")))  # a row each
        row.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return open_


def claims(spark: SparkSession, root: str, shards: int) -> DataFrame:
    """(s1_id, tid, score, rank) of all shards."""
    return spark.read.parquet(*[f"{root}/shard={s}/claims" for s in range(shards)]).select("s1_id", "tid", "score", "rank")


def candidate_lists(spark: SparkSession, root: str, shards: int) -> DataFrame:
    return spark.read.parquet(*[f"{root}/shard={s}/candidates" for s in range(shards)])


def linked(spark: SparkSession, root: str, shards: int) -> DataFrame:
    """Matches of all shards, each target once."""
    return decisions.one_to_one(claims(spark, root, shards))
