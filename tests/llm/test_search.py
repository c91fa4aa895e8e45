"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.llm import topk


def brute(rows, asked, k, scale=64):
    """(query, rank, id, score) in unbounded integers; repeated rows count once."""
    whole = {(i, tuple(math.floor(scale * x) if abs(x) < 2.0**52 else int(x) * scale for x in e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for qi, q in sorted(x for x in whole if asked(x[0])):
        best = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), i) for i, e in whole if i != qi and len(e) == len(q))[:k]
        out += [(qi, r + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


def test_all_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 0.3]) for i in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (120, rows[20][1]), (140, None), (141, []), (160, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (161, [math.nan] * 6), (180, [math.inf] * 6), (200, [1.0, 2.0]), (201, [3.0, 4.0]), (None, rows[1][1])]
    rows += [(220, [1e30, -1e6, 1e6, 0.3, -0.7, 1e30]), (221, [1e6] * 6), (222, [-1e6, 1e6, 0.0, 2e5, 3e5, -4e5]), (223, [1e308] * 6), (240, [0.0] * 6), (260, [-1e300, 0.1, 0.2, 0.3, 0.4, 0.5])]
    rows += [(40, rows[3][1]), (40, rows[7][1]), (60, rows[60][1]), (60, rows[60][1]), (7, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "'x' as rank", "2 as h1", "3 as own")
    v = topk.integer_vectors(df, "vec_id", "embedding", 64)
    for k in (3, 20, 500):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.filter("id % 20 = 0"), k).collect()]
        assert sorted(got, key=repr) == brute(rows, lambda i: i % 20 == 0, k)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        topk.integer_vectors(df, "vec_id", "embedding", 60)


@pytest.mark.parametrize("least", [1, 1000])
def test_a_vector_that_a_third_has(spark, least, monkeypatch):
    """Copies are one class; small blocks and tiles of queries, whole scans and many shares."""
    rng = np.random.default_rng(1)
    hot = [float(x) for x in rng.normal(size=8)]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    for name, value in (("BLOCK", 64), ("TILE", 200), ("QUERY_TILE", 8), ("TASKS", 5), ("AT_ONCE", 3), ("LEAST_QUERIES", least)):
        monkeypatch.setattr(topk, name, value)
    v = topk.integer_vectors(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e")
    got = topk.top_k(v, v.filter("id % 20 = 0"), 5).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=repr) == brute(rows, lambda i: i % 20 == 0, 5)


def test_few_exact_vectors_are_read(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    reads = topk.top_k(v, v.filter("id % 20 = 0")).filter("rank = 1").agg({"reads": "avg"}).first()[0]
    assert reads < 0.2 * v.count()


@settings(deadline=None)
@given(st.integers(1, 60), st.integers(1, 8), st.integers(0, 1 << 30), st.sampled_from([3, 200, 1 << 20]))
def test_cells_bound_the_products(n, dim, seed, scale):
    rng = np.random.default_rng(seed)
    data, q = rng.integers(-scale, scale, (n, dim)), rng.integers(-scale, scale, (4, dim))
    lower, upper = topk.Grid.of(data).bounds(q.astype(float))
    assert (lower <= q @ data.T).all() and (upper >= q @ data.T).all()


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 120), st.integers(1, 5), st.integers(1, 9), st.integers(0, 1 << 30), st.sampled_from([0.05, 3.0, 1e7, 1e40]))
def test_scan_keeps_the_best(tmp_path_factory, n, dim, k, seed, size):
    rng = np.random.default_rng(seed)
    data = np.floor(rng.normal(size=(n, dim)) * size * 64) / 64 if size < 1e30 else rng.normal(size=(n, dim)) * size
    wide = bool(np.abs(data).max() >= topk.LARGEST / 64)
    folder = tmp_path_factory.mktemp("tile")
    ids = [[2 * i, 2 * i + 1] for i in range(n)]
    with open(folder / "c", "wb") as c, open(folder / "e", "wb") as e:
        topk.write_blocks(((ids[a : a + 50], data[a : a + 50]) for a in range(0, n, 50)), wide, 64, 3, c, e)
    tile = {"dim": dim, "wide": wide, "cells": (folder / "c").as_uri(), "exact": (folder / "e").as_uri()}
    queries, own = np.concatenate([data[:3], np.zeros((1, dim))]), [None, *[0] * (len(data[:3]) - 1), None]
    near = [topk.in_order(held) for held in topk.scan([tile], queries, own, k)]
    files = topk.ExactFiles(3)
    for q, o, (_, best) in zip(queries, own, topk.refined(queries, own, near, [(tile["exact"], wide)], files, 64, k), strict=True):
        whole = [topk.whole_numbers(x, 64) for x in data]
        want = sorted((-sum(a * b for a, b in zip(topk.whole_numbers(q, 64), w, strict=True)), i) for w, x in zip(whole, ids, strict=True) for i in x if i != o)[:k]
        assert [(-s, i) for i, s in best] == want
    files.close()
