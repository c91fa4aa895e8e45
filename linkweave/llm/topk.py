"""Exact top-k search by inner product with vector-approximation files.

Two files hold a tile of vectors: one their approximations, every component as a cell of
a few bits on a grid of its block's own range, and one the exact vectors, record after
record.  A scan task reads approximations alone.  A query's cells bound each inner
product from above and below; the k-th best lower bound seen is a threshold, and what
cannot reach it is dropped.  Exact vectors are then read from their places in the second
file, in order of their upper bounds, until a query's k-th exact score is above the next
bound.

Only queries and bounds are dealt out: a scan task has one tile of queries and a share
of the vector tiles, and keeps its thresholds from tile to tile, so a query is in the
shuffles once for each of a few shares, however many vectors there are.  Equal vectors
are scanned once, as one class with its smallest ids, and equal queries are asked once,
so a vector that a third of all rows have makes no square of anything.

Scores are whole numbers: component x counts as floor(scale * x).  Vectors whose
whole numbers stay below ``LARGEST`` are scored in 64 bits; others ("wide") have
floating-point numbers for cells and are scored in unbounded integers.

Defined results: vectors that are null, empty (a choice: there is no product to rank) or
hold null or non-finite components take no part, all other finite ones do; vectors meet
those of equal length only; rows with a null id take no part; a row that repeats both id
and vector counts once, other rows of equal ids are rows of their own that never meet
queries of that id; ties go to the smaller id; with fewer than k rows all are
returned; a score that 64 bits cannot hold is ranked right and returned as null; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

K = 20
SCALE = 64
#: Cells of a component: 2 to this many.
CELL_BITS = 5
#: Vectors of a block, which has a grid of its own; vectors and queries of a tile, about.
BLOCK, TILE, QUERY_TILE = 4096, 1 << 18, 4096
#: Queries that are bounded at once, and that read exact vectors at once.
AT_ONCE = 256
#: Scan tasks that are aimed at, and queries that a task should have at least; with fewer, vector tiles are shared out.
TASKS, LEAST_QUERIES = 24, 64
#: Whole numbers of wide vectors are this large at least.
LARGEST = 1 << 24
#: Bounds are held with queries of about 2 ** LIFT and vectors divided by 2 ** SHRINK: nothing overflows, or is lost below.
LIFT, SHRINK = 100, 128
#: Neighbours of an exact file that are no further apart are read together.
GAP = 1 << 15
#: Rows of a class's results that its queries are dealt to.
SALT = 16
TILES = "dim int, wide boolean, cells string, exact string, rows long"


def whole_parts(x: Column, scale: int) -> Column:
    """floor(scale * x) / scale for a scale that is a power of two: exact, and equal where the whole numbers are."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x * scale).cast("double") / scale).otherwise(x)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id long, v array<double>) of those that take part; the whole numbers are ``scale * v``."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two")
    v = df[vector_col].cast("array<double>")
    fit = df[id_col].isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(fit, F.lit(False))).select(df[id_col].cast("long").alias("id"), F.transform(v, lambda x: whole_parts(x, scale)).alias("v"))


def keyed(vectors: DataFrame) -> DataFrame:
    """(id, v, h1, h2): 128 bits stand for a vector."""
    return vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def whole_numbers(v: np.ndarray, scale: int) -> list[int]:
    """``scale * v`` of any size."""
    return [int(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in v.tolist()]


class Grid:
    """Cells of a block's vectors of whole numbers below LARGEST, and the bounds they give."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray):
        self.low, self.width, self.cells = low, width, cells

    @classmethod
    def of(cls, data: np.ndarray, bits: int = CELL_BITS) -> Grid:
        low, high = data.min(axis=0), data.max(axis=0)
        width = (high - low) // (1 << bits) + 1
        return cls(low, width, ((data - low) // width).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of each query's inner product with each vector."""
        floor = (self.cells.astype(np.float64) * self.width + self.low).T
        base = queries @ floor
        reach = self.width.astype(np.float64) - 1
        # More than the sums can have been rounded by; nothing is rounded where they are short.
        slack = np.abs(queries) @ np.abs(floor).max(axis=1) * (queries.shape[1] * 2.0**-50)
        return base + (np.minimum(queries, 0) @ reach - slack)[:, None], base + (np.maximum(queries, 0) @ reach + slack)[:, None]


class Floats:
    """A block of wide vectors with floating-point numbers, divided by 2 ** SHRINK, for cells."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = queries @ self.cells.T
        slack = np.abs(queries) @ np.abs(self.cells).T * (queries.shape[1] * 2.0**-50)
        return base - slack, base + slack


def record_type(dim: int, wide: bool, depth: int) -> np.dtype:
    """What an exact file holds of a class: its smallest ids, in order, and its vector."""
    return np.dtype([("n", "<i8"), ("ids", "<i8", (depth,)), ("v", "<f8" if wide else "<i8", (dim,))])


def write_blocks(blocks: Iterator[tuple[list[list[int]], np.ndarray]], wide: bool, scale: int, depth: int, cells, exact) -> int:
    """Write both files of a tile from blocks of (ids, vectors); returns the number of rows."""
    total = 0
    for ids, data in blocks:
        whole = data if wide else np.floor(data * scale).astype(np.int64)
        record = np.zeros(len(data), record_type(data.shape[1], wide, depth))
        record["n"], record["v"] = [len(x) for x in ids], whole
        for i, x in enumerate(ids):
            record["ids"][i, : len(x)] = x
        exact.write(record.tobytes())
        held = io.BytesIO()
        np.save(held, np.array([(x[0], x[1] if len(x) > 1 else x[0]) for x in ids], np.int64))
        if wide:
            np.save(held, np.ldexp(data, scale.bit_length() - 1 - SHRINK))
        else:
            grid = Grid.of(whole)
            for x in (grid.low, grid.width, grid.cells):
                np.save(held, x)
        cells.write(len(data).to_bytes(8, "little") + len(held.getvalue()).to_bytes(8, "little") + held.getvalue())
        total += len(data)
    return total


def read_blocks(uri: str, wide: bool) -> Iterator[tuple[int, np.ndarray, Grid | Floats]]:
    """(first row, each row's two smallest ids, approximations) of the blocks of a tile, one at a time."""
    fs, path = storage.filesystem(uri)
    at = 0
    with fs.open_input_stream(path) as f:
        while head := f.read(16):
            held = io.BytesIO(f.read(int.from_bytes(head[8:], "little")))
            yield at, np.load(held), Floats(np.load(held)) if wide else Grid(np.load(held), np.load(held), np.load(held))
            at += int.from_bytes(head[:8], "little")


def write_tiles(classes: DataFrame, folder: str, scale: int, depth: int) -> str:
    """Write ``classes(v, ids)`` to tiles, whole or not at all; returns the path of their manifest (TILES)."""
    dim, wide = F.size("v"), F.exists("v", lambda x: F.abs(x) >= LARGEST / scale)
    n = classes.count()
    dealt = classes.select("ids", "v", dim.alias("dim"), wide.alias("wide")).repartition(max(1, min(TASKS, n // BLOCK), -(-n // TILE)), F.xxhash64("v"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        rows = (row for b in batches for row in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(0).to_pylist(), (x.values.to_numpy() for x in b.column(1)), strict=True))
        for (dim, wide), own in groupby(rows, lambda r: r[:2]):

            def blocks() -> Iterator[tuple[list[list[int]], np.ndarray]]:
                ids, data = [], []
                for _, _, x, v in own:
                    ids.append(x)
                    data.append(v)
                    if len(data) == BLOCK:
                        yield ids, np.stack(data)
                        ids, data = [], []
                if data:
                    yield ids, np.stack(data)

            tile, counts = uuid4().hex, []
            cells, exact = (f"{folder}/{x}/{tile}" for x in ("cells", "exact"))
            storage.write_whole(cells, lambda c: storage.write_whole(exact, lambda e: counts.append(write_blocks(blocks(), wide, scale, depth, c, e))))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "wide": pa.array([wide]), "cells": [cells], "exact": [exact], "rows": pa.array(counts, pa.int64())})

    return storage.one_file(dealt.sortWithinPartitions("dim", "wide").mapInArrow(write, TILES), f"{folder}/tiles")


def tiles_of(manifest: str, dim: int) -> list[dict]:
    """The tiles of vectors of this length, in an order that is the same for all tasks."""
    import pyarrow.dataset as ds

    fs, path = storage.filesystem(manifest)
    rows = ds.dataset(path, format="parquet", filesystem=fs).to_table(filter=ds.field("dim") == dim).to_pylist()
    return sorted(rows, key=lambda r: r["exact"])


def lifted(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries whose largest component is about 2 ** LIFT, and the powers of two they were multiplied by."""
    _, power = np.frexp(np.abs(data).max(axis=1))
    return np.ldexp(data, LIFT - power[:, None]), LIFT - power


class Threshold:
    """The k best lower bounds of each query, and the rows whose upper bounds reach the last of them."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.best = np.full((queries, k), -np.inf)
        #: For each query (tile, rows, lower, upper, smallest ids).
        self.rows: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(queries)]

    def add(self, first: int, tile: int, row: int, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray) -> None:
        """Bounds of queries from ``first`` on and rows of ``tile`` from ``row`` on; -inf: the row is barred."""
        k, own = min(self.k, lower.shape[1]), slice(first, first + len(lower))
        both = np.concatenate([self.best[own], np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k :]], axis=1)
        self.best[own] = np.partition(both, k, axis=1)[:, k:]
        near = (upper >= self.best[own].min(axis=1)[:, None]) & (upper > -np.inf)
        for q in np.flatnonzero(near.any(axis=1)):
            at = np.flatnonzero(near[q])
            self.rows[first + q].append((tile, at + row, lower[q, at], upper[q, at], ids[at]))

    def prune(self) -> None:
        """Drop what cannot be among the k best; of rows known to tie with the last of them, keep the k of smallest ids."""
        for q, least in enumerate(self.best.min(axis=1)):
            kept, ties = [], []
            for t, *of_rows in self.rows[q]:
                _, lower, upper, ids = of_rows
                tie = (upper == least) & (lower == least)
                ties.append(ids[tie])
                kept.append((t, of_rows, upper >= least, tie))
            last = np.sort(np.concatenate(ties))[: self.k] if ties else np.zeros(0, np.int64)
            most = last[-1] if len(last) == self.k else np.iinfo(np.int64).max
            chosen = ((t, of_rows, ok & ~(tie & (of_rows[3] > most))) for t, of_rows, ok, tie in kept)
            self.rows[q] = [(t, *(x[ok] for x in of_rows)) for t, of_rows, ok in chosen if ok.any()]


def scan(tiles: list[dict], data: np.ndarray, own: list[int | None], k: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each query the (tile, rows, upper bounds) of what may be among its k best; ``own``: an id that is barred."""
    queries, _ = lifted(data)
    barred = np.array([x is not None for x in own])
    names = np.array([0 if x is None else x for x in own], np.int64)
    found = Threshold(len(data), k)
    for t, tile in enumerate(tiles):
        for row, ids, block in read_blocks(tile["cells"], tile["wide"]):
            for first in range(0, len(queries), AT_ONCE):
                at = slice(first, first + AT_ONCE)
                lower, upper = block.bounds(queries[at])
                if not tile["wide"]:
                    lower, upper = np.ldexp(lower, -SHRINK), np.ldexp(upper, -SHRINK)
                if not barred[at].any():
                    found.add(first, t, row, lower, upper, ids[:, 0])
                    continue
                for q in range(first, first + len(lower)):  # few: ids of several vectors
                    mine = (ids == names[q]) & barred[q]
                    out = mine.all(axis=1)  # rows with no other id than the query's
                    lower[q - first, out] = upper[q - first, out] = -np.inf
                    found.add(q, t, row, lower[q - first : q - first + 1], upper[q - first : q - first + 1], np.where(mine[:, 0], ids[:, 1], ids[:, 0]))
        found.prune()
    return [[(t, rows, upper) for t, rows, _, upper, _ in held] for held in found.rows]


class ExactFiles:
    """Exact vectors by file and row."""

    def __init__(self, depth: int):
        self.depth, self.open = depth, {}

    def records(self, uri: str, dim: int, wide: bool, rows: np.ndarray) -> np.ndarray:
        """The records of the ascending ``rows``; neighbours are read together."""
        if uri not in self.open:
            fs, path = storage.filesystem(uri)
            self.open[uri] = fs.open_input_file(path)
        kind, out = record_type(dim, wide, self.depth), []
        for run in np.split(rows, np.flatnonzero(np.diff(rows) * kind.itemsize > GAP) + 1):
            self.open[uri].seek(int(run[0]) * kind.itemsize)
            held = np.frombuffer(self.open[uri].read(int(run[-1] - run[0] + 1) * kind.itemsize), kind)
            out.append(held[run - run[0]])  # not what lies between
        return np.concatenate(out)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def exact_scores(query: np.ndarray, vectors: np.ndarray, wide: bool, scale: int) -> list[int]:
    """Inner products of whole numbers; ``query`` as given, ``vectors`` as their file holds them."""
    if not wide and np.abs(query).max() < LARGEST / scale:
        return (vectors @ np.floor(query * scale).astype(np.int64)).tolist()
    own = whole_numbers(query, scale)
    return [sum(a * b for a, b in zip(own, whole_numbers(v, scale) if wide else v.tolist(), strict=True)) for v in vectors]


def is_above(score: int, bound: float, power: int) -> bool:
    """Whether a score is above ``bound * 2 ** power``, in whole numbers."""
    top, bottom = bound.as_integer_ratio()
    return score * bottom > top << power if power >= 0 else (score * bottom) << -power > top


def refined(queries: np.ndarray, own: list[int | None], candidates: list[tuple[np.ndarray, np.ndarray, np.ndarray]], tiles: list[tuple[str, bool]], files: ExactFiles, scale: int, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(vectors read, (id, score) of the k best, best first) of each query.

    ``candidates``: (upper bounds in descending order, places in ``tiles(file, wide)``,
    rows).  All queries read their next k at once, so that a file is read in its order.
    """
    _, powers = lifted(queries)
    shift = [SHRINK + scale.bit_length() - 1 - int(p) for p in powers]
    at, found, left = [0] * len(queries), [[] for _ in queries], list(range(len(queries)))
    while left:
        step = {q: (candidates[q][1][at[q] : at[q] + k], candidates[q][2][at[q] : at[q] + k]) for q in left}
        tile_of, row_of = (np.concatenate([x[i] for x in step.values()]) for i in (0, 1))
        rows = {t: np.unique(row_of[tile_of == t]) for t in np.unique(tile_of).tolist()}
        held = {t: files.records(tiles[t][0], queries.shape[1], tiles[t][1], r) for t, r in rows.items()}
        going = []
        for q in left:
            for t in np.unique(step[q][0]).tolist():
                got = held[t][np.searchsorted(rows[t], step[q][1][step[q][0] == t])]
                for score, n, ids in zip(exact_scores(queries[q], got["v"], tiles[t][1], scale), got["n"].tolist(), got["ids"].tolist(), strict=True):
                    found[q] += [(-score, i) for i in ids[:n] if i != own[q]]
            found[q] = sorted(found[q])[:k]
            upper = candidates[q][0]
            at[q] = min(at[q] + k, len(upper))
            # The next may still reach the k-th, were it as a tie.
            if at[q] < len(upper) and not (len(found[q]) == k and is_above(-found[q][-1][0], float(upper[at[q]]), shift[q])):
                going.append(q)
        left = going
    for q, best in enumerate(found):
        yield at[q], [(i, -s) for s, i in best]


def in_order(held: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper bounds in descending order, tiles, rows) of (tile, rows, upper bounds)."""
    if not held:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper, rows = np.concatenate([x[2] for x in held]), np.concatenate([x[1] for x in held])
    tiles = np.repeat([x[0] for x in held], [len(x[1]) for x in held])
    order = np.lexsort((rows, tiles, -upper))
    return upper[order], tiles[order], rows[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score, reads) from ``vectors(id, v)`` and ``queries(id, v)`` of ``integer_vectors``.

    ``reads``: how many exact vectors were read for the query and those equal to it.
    """
    spark, depth = vectors.sparkSession, k + 1
    folder = storage.new_path(spark, "vectors")
    rows = keyed(vectors)
    # A class needs no more than its k + 1 smallest ids: a query's own is one of them at most.
    first = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.select("id", "h1", "h2").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= depth)
    ids = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = storage.written(rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(ids, ["h1", "h2"]).select("v", "ids"), "classes")
    manifest = write_tiles(classes, folder, scale, depth)

    asked = keyed(queries)
    # Ids of several vectors: their queries are asked apart, as they bar more than one class.
    several = storage.written(rows.groupBy("id").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d")).filter("a <> b or c <> d").select("id", F.col("id").alias("own")), "several")
    members = storage.written(asked.select("id", "h1", "h2").distinct().join(several, "id", "left"), "members")
    units = storage.written(asked.join(several, "id", "left").groupBy("h1", "h2", "own").agg(F.first("v").alias("v")), "units")
    n = units.count()
    # Few queries: the vector tiles are shared out, and what each share may give is brought together.
    query_tiles = max(1, -(-n // QUERY_TILE), min(TASKS, n // LEAST_QUERIES))
    shares = max(1, TASKS // query_tiles) if n < TASKS * LEAST_QUERIES else 1
    key = F.pmod(F.xxhash64("h1", "h2", "own"), F.lit(query_tiles)).cast("int") * shares + F.col("share")
    spread = units.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("key", key).withColumn("dim", F.size("v"))
    dealt = spread.select("key", "dim", "share", "h1", "h2", "own", "v").repartition(query_tiles * shares, "key").sortWithinPartitions("key", "dim")
    found = "h1 long, h2 long, own long, reads long, best array<struct<vec_id:long,score:long>>"
    best_type = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))

    def settled(units: list[tuple], candidates: list[tuple], tiles: list[tuple[str, bool]], files: ExactFiles) -> Iterator[pa.RecordBatch]:
        """Results of units (h1, h2, own, v) of equal length."""
        for at in range(0, len(units), AT_ONCE):
            part = units[at : at + AT_ONCE]
            reads, best = zip(*refined(np.stack([u[3] for u in part]), [u[2] for u in part], candidates[at : at + AT_ONCE], tiles, files, scale, depth), strict=True)
            fit = [[{"vec_id": i, "score": s if -(1 << 63) <= s < 1 << 63 else None} for i, s in b] for b in best]
            yield pa.RecordBatch.from_arrays([*(pa.array([u[i] for u in part], pa.int64()) for i in range(3)), pa.array(reads, pa.int64()), pa.array(fit, best_type)], names=["h1", "h2", "own", "reads", "best"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple], list[dict]]]:
        """(units, what may be among their best, tiles) of each tile of queries."""
        records = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6)), (x.values.to_numpy() for x in b.column(6)), strict=True))
        for (_, dim, share), group in groupby(records, lambda r: r[:3]):
            units = [r[3:] for r in group]
            tiles = tiles_of(manifest, dim)[share::shares]
            near = scan(tiles, np.stack([u[3] for u in units]), [u[2] for u in units], depth)
            yield units, [in_order(x) for x in near], tiles

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ExactFiles(depth)
        for units, candidates, tiles in scanned(batches):
            yield from settled(units, candidates, [(t["exact"], t["wide"]) for t in tiles], files)
        files.close()

    near_type = pa.list_(pa.struct([("upper", pa.float64()), ("exact", pa.string()), ("wide", pa.bool_()), ("row", pa.int64())]))

    def run_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, candidates, tiles in scanned(batches):
            near = [[{"upper": u, "exact": tiles[t]["exact"], "wide": tiles[t]["wide"], "row": r} for u, t, r in zip(*(x.tolist() for x in c), strict=True)] for c in candidates]
            yield pa.RecordBatch.from_arrays([*(pa.array([u[i] for u in units], pa.int64()) for i in range(3)), pa.array([u[3] for u in units], pa.list_(pa.float64())), pa.array(near, near_type)], names=["h1", "h2", "own", "v", "near"])

    def run_refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ExactFiles(depth)
        records = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), (x.values.to_numpy() for x in b.column(3)), b.column(4).to_pylist(), strict=True))
        for unit, group in groupby(records, lambda r: r[:3]):
            group = list(group)
            near = [c for g in group for c in g[4]]
            tiles = sorted({(c["exact"], c["wide"]) for c in near})
            place = {x: i for i, x in enumerate(tiles)}
            arrays = in_order([(place[c["exact"], c["wide"]], np.array([c["row"]]), np.array([c["upper"]])) for c in near])
            yield from settled([(*unit, group[0][3])], [arrays], tiles, files)
        files.close()

    if shares == 1:
        best = dealt.mapInArrow(run_whole, found)
    else:
        near = dealt.mapInArrow(run_share, "h1 long, h2 long, own long, v array<double>, near array<struct<upper:double,exact:string,wide:boolean,row:long>>")
        best = near.repartition(query_tiles * shares, "h1", "h2", "own").sortWithinPartitions("h1", "h2", "own").mapInArrow(run_refine, found)
    # A unit's row is sent SALT times, so that the queries of one vector meet it in as many tasks.
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).alias("m").join(salted.alias("b"), (F.col("m.h1") == F.col("b.h1")) & (F.col("m.h2") == F.col("b.h2")) & F.col("m.own").eqNullSafe(F.col("b.own")) & (F.col("m.salt") == F.col("b.salt")))
    own = F.slice(F.filter("b.best", lambda x: x["vec_id"] != F.col("m.id")), 1, k)
    each = met.select(F.col("m.id").alias("query_id"), F.col("b.reads").alias("reads"), F.posexplode(own).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score", "reads")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import table

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("id") % 20 == 0)).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, i, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM n q JOIN n c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
