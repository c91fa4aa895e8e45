"""Linking records that arrive over time: each micro-batch is linked against stored targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkweave.plans.link import LinkConfig, link
from linkweave.sources.records import of_source


def link_batch(batch: DataFrame, targets: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Matches of one batch of S1 records among the stored targets."""
    return link(of_source(batch, "S1").unionByName(of_source(targets, "S2", "S3")), config)


def link_stream(arrivals: DataFrame, targets: DataFrame, output: str, checkpoint: str, config: LinkConfig = LinkConfig()) -> StreamingQuery:
    """Matches of a stream of S1 records, appended to Parquet at ``output`` by batch.

    A batch that is run again overwrites its own folder, so each is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        link_batch(batch, targets, config).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
