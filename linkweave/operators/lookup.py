"""Profiles of pairs by look-up: both are read from files where the pair is, so wide rows are never shuffled.

Profiles are written once, in slices by a hash of the id.  Pairs, which are narrow, are
dealt by the record's slice and sorted by the target's; a task then holds one slice of
each side at a time, and reads a target's slice once for each of its record's slices.
Pairs that are stored in that order with both numbers (``Slices.dealt``) are not dealt again.

Defined results: those of two inner joins by id.  Ids that are null or have no profile
give no rows, and ids with several profiles a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.sources.paths import dealt_files, part_of

#: Records and targets of a slice, about.
ROWS, TILE = 20_000, 40_000
#: Slices of records that are aimed at where there are few, as tasks are made of them.
TASKS = 16
#: Pairs that go on at once.
BATCH = 4_000


def _slice_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Slices:
    """How many slices the records and the targets have."""

    rows: int
    tiles: int

    @classmethod
    def of(cls, queries: DataFrame, targets: DataFrame) -> Slices:
        n = queries.count()
        return cls(max(1, -(-n // ROWS), min(TASKS, n)), max(1, -(-targets.count() // TILE)))

    def by_row(self, pairs: DataFrame) -> DataFrame:
        """Pairs dealt by their record's slice, which is added as ``_row``."""
        return pairs.withColumn("_row", _slice_of("s1_id", self.rows)).repartition(self.rows, "_row")

    def dealt(self, by_row: DataFrame) -> DataFrame:
        """``by_row`` with the target's slice as ``_tile``, in the order of both."""
        return by_row.withColumn("_tile", _slice_of("tid", self.tiles)).sortWithinPartitions("_row", "_tile")


class Slice:
    """Profiles of one slice, in order of their ids."""

    def __init__(self, files: str, number: int):
        table = part_of(files, number)
        self.table = table.combine_chunks().sort_by("entity_id") if table.num_rows else table
        self.first: dict[str, int] = {}
        self.count: dict[str, int] = {}
        for i, x in enumerate(self.table["entity_id"].to_pylist() if table.num_rows else ()):
            self.first.setdefault(x, i)
            self.count[x] = self.count.get(x, 0) + 1
        self.unique = len(self.first) == table.num_rows

    def places(self, ids: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each profile of the ids: which of ``ids``, and its row."""
        first = np.array([self.first.get(x, -1) for x in ids], np.int64)
        if self.unique:
            at = np.flatnonzero(first >= 0)
            return at, first[at]
        count = np.array([self.count.get(x, 0) for x in ids], np.int64)
        at = np.repeat(np.arange(len(ids)), count)
        return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def with_profiles_of(pairs: DataFrame, queries: DataFrame, targets: DataFrame, columns: list[str], slices: Slices | None = None) -> DataFrame:
    """Pairs with the columns of both profiles, prefixed s_ and t_.  ``slices``: those that ``pairs`` are stored in."""
    dealt, slices = slices is not None, slices or Slices.of(queries, targets)
    sides = ((queries, slices.rows, "s"), (targets, slices.tiles, "t"))
    s_files, t_files = (dealt_files(df.select("entity_id", *columns).withColumn("slice", _slice_of("entity_id", n)), "slice", "slices") for df, n, _ in sides)
    kinds = dict(queries.select("entity_id", *columns).dtypes)
    keep = [c for c in pairs.columns if c not in ("_row", "_tile")]
    ordered = (pairs if dealt else slices.dealt(slices.by_row(pairs))).select(*keep, "_row", "_tile")
    schema = [*ordered.dtypes[:-2], *((f"{x}_{c}", kinds[c]) for _, _, x in sides for c in columns)]
    s_at, t_at, n_own, names = keep.index("s1_id"), keep.index("tid"), len(keep), [n for n, _ in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, tile, s, t = -1, -1, None, None
        for batch in batches:
            where = np.stack([batch.column(n_own + i).to_numpy() for i in (0, 1)])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if row != where[0, a]:
                    row = int(where[0, a])
                    s = Slice(s_files, row)
                if tile != where[1, a]:
                    t, tile = None, int(where[1, a])  # the old one goes first
                    t = Slice(t_files, tile)
                for at in range(a, b, BATCH):
                    made = _attached(batch.slice(at, min(BATCH, b - at)), n_own, s_at, t_at, s, t, columns, names)
                    if made.num_rows:
                        yield made

    return ordered.mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in schema))


def _attached(some: pa.RecordBatch, n_own: int, s_at: int, t_at: int, s: Slice, t: Slice, columns: list[str], names: list[str]) -> pa.RecordBatch:
    i, s_rows = s.places(some.column(s_at).to_pylist())
    j, t_rows = t.places(some.column(t_at).take(pa.array(i)).to_pylist())
    pair, s_rows = pa.array(i[j]), s_rows[j]
    if not len(pair):
        return pa.RecordBatch.from_arrays([some.column(x).slice(0, 0) for x in range(n_own)], names=names[:n_own])
    out = [some.column(x).take(pair) for x in range(n_own)]
    for side, rows in ((s, pa.array(s_rows)), (t, pa.array(t_rows))):
        out += [side.table[c].chunk(0).take(rows) for c in columns]
    return pa.RecordBatch.from_arrays(out, names=names)
