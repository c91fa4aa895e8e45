"""Shards against brute force: the whole records, in the order of their keys, cut where the bytes say."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkweave.llm import sharding, storage


def brute(spark, docs, shards):
    """(doc_id, size, crc32, shard, slot) of all rows, sorted and cut in one place."""
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(((r.h, -(1 << 63) if r.doc_id is None else r.doc_id, r.doc_id, (r.text or "").encode()) for r in keyed), key=lambda r: r[:2])
    total, before, out, first = sum(len(r[3]) + 1 for r in rows), 0, [], {}
    for at, (_, _, doc_id, text) in enumerate(rows):
        size = len(text) + 1
        shard = min(int((before + size / 2) * shards // total), shards - 1)
        first.setdefault(shard, at)
        out.append((doc_id, size, zlib.crc32(text), shard, at - first[shard]))
        before += size
    return out


def sharded(docs, shards=8):
    rows = sharding.sharded(docs, shards).collect()
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None for r in rows)
    return [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def test_all_cases(spark, documents, nothing):
    named = documents.withColumns({c: F.lit(1) for c in ("range", "place", "h", "id", "size", "c0", "slot")})
    assert same(sharded(named), brute(spark, named, 8))
    assert sharding.sharded(nothing).count() == 0


def test_shards_hold_the_records(spark, documents, monkeypatch):
    made = []
    path = storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, name: made.append((name, path(s, name))) or made[-1][1])
    out = sharded(documents)
    files = spark.read.parquet(dict(made)["shards"]).drop("place", "shard").toDF(*documents.columns)
    assert same((tuple(r) for r in files.collect()), (tuple(r) for r in documents.collect())) and len(out) == documents.count()


@pytest.mark.parametrize("hot", ["text", "key", "giants"])
def test_overfull_ranges_are_divided(spark, hot, monkeypatch):
    """Ranges that take second and third rounds, as a text, a key or a few long texts fill them."""
    monkeypatch.setattr(sharding, "LEAST_RANGES", 16)
    monkeypatch.setattr(sharding, "PER_RANGE", 2)
    monkeypatch.setattr(sharding, "OVERFULL", 1.2)
    rounds = []
    place = sharding.range_of
    monkeypatch.setattr(sharding, "range_of", lambda df, bounds: rounds.append(len(bounds)) or place(df, bounds))
    r = random.Random(0)
    if hot == "text":
        rows = [(i, "hot " * 50 if i % 3 == 0 else "x" * r.randrange(300)) for i in range(3000)]
    elif hot == "key":
        rows = [(None if i % 3 == 0 else i, "hot " * 50 if i % 3 == 0 else "x" * r.randrange(300)) for i in range(3000)]
    else:
        rows = [(i, f"{i} " * (20_000 if i % 500 == 0 else 3)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharded(docs)
    assert same(found, brute(spark, docs, 8))
    assert len(rounds) >= 3  # sums twice at least, and the records
    sums = pd.DataFrame(found, columns=["id", "size", "crc", "shard", "slot"]).groupby("shard")["size"].sum()
    if hot != "giants":
        assert sums.max() - sums.min() <= 2 * 301
    assert same(found, sharded(docs.repartition(7)))


def test_places_among_bounds():
    r = np.random.default_rng(0)
    bounds = np.unique(r.integers(0, 6, (9, 2)), axis=0)
    h, ids = r.integers(-1, 8, 300), r.integers(-1, 8, 300)
    want = [sum((a, b) <= (x, y) for a, b in map(tuple, bounds.tolist())) for x, y in zip(h.tolist(), ids.tolist(), strict=True)]
    assert sharding.place(bounds, h, ids).tolist() == want
