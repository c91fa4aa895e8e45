"""The queries of this subpackage: name to function of (session, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave import ship

from . import bpe, langid, packing, quality, sharding, simhash, token_counts, token_output, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def BPE_FILE() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_token_ids": token_output.query,
    "op2_token_counts": token_counts.query,
    "op3_simhash": simhash.query,
    "op4_langid": langid.query,
    "op5_topk": topk.query,
    "op6_quality": quality.query,
    "op7_warc": warc.query,
    "op8_bpe": bpe.query,
    "op9_sharding": sharding.query,
    "op10_packing": packing.query,
}

ORACLES: dict[str, str] = {
    "op5_topk": topk.ORACLE,
    "op6_quality": quality.ORACLE,
    "op7_warc": warc.ORACLE,
}
