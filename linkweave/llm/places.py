"""Rows by their place in a table's files, and lists of rows beside them.

A row of a Parquet table is named by its file and its number there, so rows without an
id, or with equal ones, are told apart, and a decision about rows comes back to them
without a shuffle of their texts: it is written as one small file beside each file of the
table, and a scan looks its rows up there.  Only places are ever shuffled.

Defined results: a DataFrame that is no plain scan of files is written first; columns of
any name are passed on; an empty table has no files and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

SIDE = "file long, path string, width int"


class Placed:
    """A table of files: ``rows`` has its columns as c0, c1, ... and ``file long, row long``."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        try:
            self.rows = self._placed(docs)
        except AnalysisException:  # no scan of files below
            self.rows = self._placed(storage.written(docs.toDF(*[f"c{i}" for i in range(len(self.names))]), "copy"))
        self.types = dict(self.rows.dtypes)

    @staticmethod
    def _placed(docs: DataFrame) -> DataFrame:
        at = docs.metadataColumn("_metadata")
        own = [docs[f"`{n.replace('`', '``')}`"].alias(f"c{i}") for i, n in enumerate(docs.columns)]
        return docs.select(*own, F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))

    def column(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def mapped(self, columns: list[str], run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
        """``run`` over batches of the columns of ``rows``.  Rows are looked up in ``run``: a stage with another Python step has twice the worker processes."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield run(batch)
            storage.trim()

        return self.rows.select(*columns).mapInArrow(each, schema)

    def without(self, gone: DataFrame) -> DataFrame:
        """The table without the rows of ``gone(file, row)``."""
        kept = self.rows.filter(~is_listed(write_beside(gone.select("file", "row"))))
        return kept.drop("file", "row").toDF(*self.names)


def is_listed(manifest: str) -> Column:
    """Whether columns file and row are listed there; only these two go to Python."""

    @F.pandas_udf("boolean")
    def found(files: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series(look_up(manifest, files.to_numpy(np.int64), rows.to_numpy(np.int64))[0])

    return found("file", "row")


def write_beside(listed: DataFrame) -> str:
    """Write ``listed(file, row, ...)`` (long columns), one file of sorted places and their values for each ``file``; returns the path of the manifest (SIDE)."""
    folder = storage.new_path(listed.sparkSession, "beside")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        def put(file: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            path = f"{folder}/rows/{uuid4().hex}"
            storage.write_whole(path, lambda out: out.write(np.concatenate(parts).astype("<i8").tobytes()))
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "path": [path], "width": pa.array([parts[0].shape[1]], pa.int32())})

        now, parts = None, []
        for batch in batches:
            files = batch.column(0).to_numpy()
            values = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts and int(files[a]) != now:
                    yield put(now, parts)
                    parts = []
                now = int(files[a])
                parts.append(values[a:b])
        if parts:
            yield put(now, parts)

    names = listed.repartition("file").sortWithinPartitions("file", "row").mapInArrow(write, SIDE)
    return storage.one_file(names, f"{folder}/manifest")


_HELD: dict[tuple[str, int], np.ndarray] = {}


def _beside(manifest: str, file: int) -> np.ndarray:
    """(row, values) in order of rows; the last few are kept by the worker process."""
    import pyarrow.dataset as ds

    if (manifest, file) not in _HELD:
        while len(_HELD) >= 4:
            del _HELD[next(iter(_HELD))]
        fs, path = storage.filesystem(manifest)
        parts = []
        for found in ds.dataset(path, format="parquet", filesystem=fs).to_table(filter=ds.field("file") == file).to_pylist():
            own, at = storage.filesystem(found["path"])
            with own.open_input_stream(at) as f:
                parts.append(np.frombuffer(f.read(), "<i8").reshape(-1, found["width"]))
        _HELD[manifest, file] = np.concatenate(parts) if parts else np.zeros((0, 1), np.int64)
    return _HELD[manifest, file]


def look_up(manifest: str, files: np.ndarray, rows: np.ndarray, values: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is listed, its so many values or 0) of each place."""
    found, out = np.zeros(len(rows), bool), np.zeros((len(rows), values), np.int64)
    for file in np.unique(files).tolist():
        listed, own = _beside(manifest, file), np.flatnonzero(files == file)
        if len(listed):
            at = np.minimum(np.searchsorted(listed[:, 0], rows[own]), len(listed) - 1)
            hit = listed[at, 0] == rows[own]
            found[own] = hit
            if values:
                out[own[hit]] = listed[at[hit], 1:]
    return found, out
