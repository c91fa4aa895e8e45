"""Micro-batches of records linked against stored targets."""

from linkweave.plans.link import link
from linkweave.sources.records import of_source
from linkweave.streaming.incremental import link_stream

COLUMNS = "entity_id string, business_name string, business_address string, country string"


def test_a_stream_gives_the_matches_of_a_batch(spark, tmp_path, rows):
    records = spark.createDataFrame([("S1-1", "Acme Widgets Inc", "12 Oak Street, Dallas", "US"), ("S1-2", "Nobody Here", "", "US"), ("S2-1", "Acme Widgets", "12 Oak St, Dallas", "US"), ("S3-9", "Other Firm", "7 Elm Road, Austin", "US")], COLUMNS)
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    of_source(records, "S1").write.parquet(arrivals)
    link_stream(spark.readStream.schema(COLUMNS).parquet(arrivals), records, out, str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(out).select("s1_id", "tid", "score", "rank")
    assert rows(got) == rows(link(records).select("s1_id", "tid", "score", "rank")) and got.count() == 1
