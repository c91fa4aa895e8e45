"""Shards of near equal bytes from sampled splitters.

A size-weighted sample of the keys gives quantile boundaries; records are dealt to the
ranges between them.  The bytes of all ranges are then summed exactly; ranges that turn
out overfull get a sample and boundaries of their own, all in one pass, until none is, or
its keys are all equal.  Shard borders are set on the exact sums, so shards differ by
about one record.  Only keys and sums come to the driver: at most about ``PER_RANGE``
keys a range, and at most ``MOST_RANGES`` ranges are aimed at.

The whole records are then range-partitioned in one shuffle, placed by running sums, and
written to their shards; all that the query returns is read from the shards' files.

The key is (hash of the text, doc_id): equal texts lie side by side, in one shard unless
a border falls among them or they are more than a shard holds; then doc_id splits them.

Defined results: a null or empty text has size 1 and crc32 0; a null doc_id sorts first;
rows with equal keys all stay and take neighbouring slots (they are one range, whatever
their number); an empty table gives no rows; other columns of any name are written as
they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

#: Bytes that a range should have; ranges that are aimed at.
RANGE_BYTES = 64 << 20
LEAST_RANGES, MOST_RANGES = 64, 1 << 16
#: Sampled keys for each range that is aimed at.
PER_RANGE = 16
#: A range with more than so many times the mean is divided again.
OVERFULL = 4
_FIRST = -(1 << 63)  # what a null id counts as


def keys_of(docs: DataFrame) -> dict[str, Column]:
    """(h, id, size) of a record."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return {"h": F.xxhash64(text), "id": F.coalesce(docs["doc_id"].cast("long"), F.lit(_FIRST).cast("long")), "size": (F.octet_length(text) + 1).cast("long")}


def place(bounds: np.ndarray, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Number of the ascending ``bounds(h, id)`` at or below each (h, id)."""
    out = np.searchsorted(bounds[:, 0], h, side="left")
    upto = np.searchsorted(bounds[:, 0], h, side="right")
    for i in np.unique(out[upto > out]):  # a text that bounds lie in
        rows = (out == i) & (upto > i)
        own = bounds[i : np.searchsorted(bounds[:, 0], bounds[i, 0], side="right"), 1]
        out[rows] += np.searchsorted(own, ids[rows], side="right")
    return out


def range_of(df: DataFrame, bounds: np.ndarray) -> Column:
    """The range of columns h and id; only these go to Python."""
    sent = df.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def found(h: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(place(sent.value, h.to_numpy(np.int64), ids.to_numpy(np.int64)), dtype="int32")

    return found("h", "id")


def drawn(keys: DataFrame, rate: Column) -> DataFrame:
    """Some of ``keys(h, id, size)``, each row with the chance size * rate.  Places do not depend on which."""
    return keys.filter(F.rand(42) < F.col("size") * rate)


def quantile_bounds(sample: pd.DataFrame, ranges: int) -> np.ndarray:
    """At most ``ranges - 1`` different (h, id), where ascending ``sample(h, id)`` is cut in equal parts."""
    s = sample[["h", "id"]].sort_values(["h", "id"]).to_numpy(np.int64)
    return np.unique(s[(np.arange(1, ranges) * len(s)) // ranges], axis=0) if len(s) and ranges > 1 else np.zeros((0, 2), np.int64)


def boundaries(keys: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Boundaries, and the exact (range, rows, bytes) between them, of ``keys(h, id, size)``."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES)))
    mean = max(1, total / ranges)
    bounds = quantile_bounds(drawn(keys, F.lit(ranges * PER_RANGE / max(1, total))).select("h", "id").toPandas(), ranges)
    while True:
        dealt = keys.withColumn("range", range_of(keys, bounds))
        key = F.struct("h", "id")
        sums = storage.written(dealt.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min(key).alias("first"), F.max(key).alias("last")), "ranges")
        over = sums.filter((F.col("bytes") > OVERFULL * mean) & (F.col("first") < F.col("last")))
        rates = storage.written(over.select("range", (PER_RANGE / F.lit(mean)).alias("rate"), "bytes"), "overfull")  # at most ranges / OVERFULL rows
        wide = rates.count()
        if not wide:
            return bounds, sums
        inside = drawn(dealt.join(F.broadcast(rates), "range"), F.col("rate")).select("range", "bytes", "h", "id").toPandas()
        fresh = [quantile_bounds(own, max(2, int(own.bytes.iloc[0] / mean) + 1)) for _, own in inside.groupby("range")]
        # A key that fills its range by itself is cut off from those before and behind it.
        ends = np.array([(r["first"]["h"], r["first"]["id"] + 1) if r["first"]["id"] < (1 << 63) - 1 else (r["first"]["h"] + 1, _FIRST) for r in over.select("first").collect()], np.int64).reshape(-1, 2)
        hot = np.concatenate([np.zeros((0, 2), np.int64), *fresh])
        after = hot + np.array([0, 1]) if len(hot) else hot
        more = np.unique(np.concatenate([bounds, hot, after[after[:, 1] > _FIRST] if len(after) else after, ends]), axis=0)
        if len(more) == len(bounds):
            return bounds, sums
        bounds = more


def write_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Whole records in a folder a shard, in their order; what is returned is read from those files.

    The columns of docs, and ``__lw_place long`` (the place in all shards) and ``__lw_shard int``.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    # By plain names: those of docs may be any.
    records = docs.select(*[docs[f"`{c.replace('`', '``')}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)], *[v.alias(k) for k, v in keys_of(docs).items()])
    bounds, sums = boundaries(docs.select(*[v.alias(k) for k, v in keys_of(docs).items()]))
    in_order = Window.orderBy("range")  # a row a range
    before = storage.written(sums.select("range", (F.sum("rows").over(in_order) - F.col("rows")).alias("rows_before"), (F.sum("bytes").over(in_order) - F.col("bytes")).alias("bytes_before"), F.sum("bytes").over(Window.partitionBy()).alias("total")), "before")
    within = Window.partitionBy("range").orderBy("h", "id")
    upto = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    dealt = records.withColumn("range", range_of(records, bounds)).repartition(len(bounds) + 1, "range")
    placed = dealt.withColumns({"n": F.row_number().over(within), "upto": upto}).join(F.broadcast(before), "range")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") + F.col("size") / 2
    shard = F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int")
    whole = placed.select(*names, (F.col("rows_before") + F.col("n") - 1).alias("place"), shard.alias("shard")).sortWithinPartitions("shard", "place")
    path = storage.new_path(docs.sparkSession, "shards")
    whole.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(whole.schema).parquet(path).toDF(*docs.columns, "__lw_place", "__lw_shard")


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every record that the shards' files hold."""
    held = write_shards(docs, shards)
    named = held.toDF(*[f"c{i}" for i in range(len(docs.columns))], "place", "shard")
    text, doc_id = (F.col(f"c{docs.columns.index(c)}") for c in ("text", "doc_id"))
    text = F.coalesce(text.cast("string"), F.lit(""))
    first = named.groupBy("shard").agg(F.min("place").alias("first"))  # a row a shard
    return named.join(F.broadcast(first), "shard").select(
        doc_id.cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import table

    return sharded(table(spark, sf_dir, "documents"), shards=8)
