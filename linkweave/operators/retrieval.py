"""Weighted overlaps of n-gram sets, in tiles: postings of a tile of targets, asked by a tile of queries.

A query's n-grams are few and each has a bounded list of postings, so what a query meets
is summed up in arrays where it is met; only its best rows, or its sums, leave the task.
No posting is ever a row of a shuffle.  Queries are sent once; targets are written once,
a folder a tile, and each task reads them from there: no copy of them is made for the
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.sources.paths import dealt_files, part_of

#: Targets and queries of a tile, about.
TARGET_TILE, QUERY_TILE = 50_000, 5_000
#: Tasks that are aimed at where there are few tiles.
TASKS = 16
FOUND = "s1_id string, tid string, score double, overlap long, q_grams int, t_grams int, rank int"


class Postings:
    """Inverted lists of a tile: for each n-gram the places of the targets that have it."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
        """``grams`` has those of all targets, one after the other."""
        starts = np.cumsum(sizes) - sizes
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.sizes = ids[self.order], sizes[self.order].astype(np.int64)
        ends = np.cumsum(self.sizes)
        flat = grams[np.arange(ends[-1]) + np.repeat(starts[self.order] - (ends - self.sizes), self.sizes)]
        by_gram = np.argsort(flat, kind="stable")
        self.grams, starts = np.unique(flat[by_gram], return_index=True)
        self.places = np.repeat(np.arange(len(ids)), self.sizes)[by_gram].astype(np.int32)
        self.ends = np.append(starts, len(flat))

    def sums(self, grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, summed weights, how many) of the targets that share some of the n-grams."""
        if not len(self.grams) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        lists = [(self.places[self.ends[a] : self.ends[a + 1]], w) for a, g, w in zip(at.tolist(), grams.tolist(), weights.tolist(), strict=True) if self.grams[a] == g]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        places, code, count = np.unique(np.concatenate([p for p, _ in lists]), return_inverse=True, return_counts=True)
        return places, np.bincount(code, np.repeat([w for _, w in lists], [len(p) for p, _ in lists])), count


def tiles(n: int, size: int, least: int = 1) -> int:
    return max(least, -(-n // size))


def overlaps(asked: DataFrame, held: DataFrame, n_asked: int, n_held: int, top: int | None) -> DataFrame:
    """FOUND from ``asked(_q, s1_id, q_grams, grams, weights)`` and ``held(_t, tid, grams)``: pairs that share n-grams.

    ``top``: of each query only the first so many, by score and then by ``_t``, ranked
    from 1; else all, with rank 0.
    """
    columns = tiles(n_held, TARGET_TILE)
    rows = tiles(n_asked, QUERY_TILE, min(TASKS, max(1, n_asked)))
    files = dealt_files(held.withColumn("tile", F.pmod(F.xxhash64("_t"), F.lit(columns)).cast("int")), "tile", "targets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), *([x.values.to_numpy() for x in b.column(i)] for i in (3, 4)), strict=True)]
        for first in range(0, len(asked), QUERY_TILE):
            yield from _answers(asked[first : first + QUERY_TILE], files, columns, top)

    return asked.select("_q", "s1_id", "q_grams", "grams", "weights").repartition(rows, "_q").mapInArrow(run, FOUND)


def _answers(asked: list[tuple], files: str, columns: int, top: int | None) -> Iterator[pa.RecordBatch]:
    """FOUND of some queries, which are held while all targets are read, tile by tile."""
    best: list[list[tuple]] = [[] for _ in asked]
    for tile in range(columns):
        held = part_of(files, tile)
        if not held.num_rows:
            continue
        grams = held["grams"].combine_chunks()
        postings = Postings(held["_t"].to_numpy(), np.diff(grams.offsets.to_numpy()), grams.flatten().to_numpy())
        names = held["tid"].combine_chunks().take(pa.array(postings.order))
        out, n = [], 0
        for i, (key, size, own, weights) in enumerate(asked):
            places, scores, shared = postings.sums(own, weights)
            scores = np.round(scores, 9)
            if top is None:
                out.append(_found(key, size, names.take(pa.array(places)), scores, shared, postings.sizes[places], np.zeros(len(places), np.int32)))
                n += len(places)
                if n > 100_000:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                    out, n = [], 0
                continue
            first = _first(scores, postings.ids[places], top)
            at = places[first]
            best[i] = [(postings.ids[at], names.take(pa.array(at)), scores[first], shared[first], postings.sizes[at]), *best[i]]
            if len(best[i]) > 1:
                best[i] = [_joined(best[i], top)]
        if n:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if top is not None:
        for at in range(0, len(asked), 1000):
            ready = [_found(key, size, *found[0][1:], np.arange(1, len(found[0][0]) + 1, dtype=np.int32)) for (key, size, _, _), found in zip(asked[at : at + 1000], best[at : at + 1000], strict=True) if found and len(found[0][0])]
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]


def _first(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the first ``top`` by score and then by id."""
    return np.lexsort((ids, -scores))[:top]


def _joined(parts: list[tuple], top: int) -> tuple:
    ids, scores, shared, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
    first = _first(scores, ids, top)
    return ids[first], pa.concat_arrays([p[1] for p in parts]).take(pa.array(first)), scores[first], shared[first], sizes[first]


def _found(key: str, size: int, names: pa.Array, scores: np.ndarray, shared: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    n = len(names)
    columns = [pa.repeat(pa.scalar(key, pa.string()), n), names, pa.array(scores), pa.array(shared.astype(np.int64)), pa.repeat(pa.scalar(size, pa.int32()), n), pa.array(sizes.astype(np.int32)), pa.array(rank)]
    return pa.RecordBatch.from_arrays(columns, names=["s1_id", "tid", "score", "overlap", "q_grams", "t_grams", "rank"])
