"""Whole files in the shared folder, for executors, and column lists.

Tables and paths there are those of ``linkweave.sources.paths``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from linkweave.sources.paths import filesystem, new_path, scratch, shared_folder, written

__all__ = ["columns", "filesystem", "mapped", "new_path", "one_file", "scratch", "shared_folder", "trim", "write_whole", "written"]


def write_whole(uri: str, produce) -> int:
    """Write a file so that it is there whole or not at all; return its size.

    ``produce(stream)`` writes it under a name of its own, then one rename puts it
    in place: a task that is run again, or twice at once, leaves one whole file.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as out:
        produce(out)
    fs.move(own, path)
    return fs.get_file_info(path).size


def one_file(manifest: DataFrame, path: str) -> str:
    """Write a table of names, a row a file, so that tasks can look it up by opening one file; returns ``path``.

    What makes the rows runs in as many tasks as it has; only they come together.
    """
    made = f"{path}-parts"
    manifest.write.parquet(made)
    manifest.sparkSession.read.schema(manifest.schema).parquet(made).repartition(1).write.parquet(path)
    return path


def trim() -> None:
    """Give memory that is free back to the system: worker processes live on, and others need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns, whatever signs their names hold."""
    return df.select(*[df[f"`{n.replace('`', '``')}`"] for n in names])


def mapped(df: DataFrame, keep: list[str], run, more: str) -> DataFrame:
    """``keep`` columns of ``df`` and those of the DDL ``more``, by ``run(text's place, keep's new names)``, a mapInArrow function.

    Text is sent once, as one of ``keep`` or after them.  Columns go by plain names
    meanwhile, as mapInArrow takes no others.
    """
    sent = keep if "text" in keep else [*keep, "text"]
    plain = [f"c{i}" for i in range(len(sent))]
    out = columns(df, sent).toDF(*plain)
    kinds = [k for _, k in out.dtypes]
    names = plain[: len(keep)]
    each = run(sent.index("text"), names)

    def trimmed(batches):
        yield from each(batches)
        trim()

    made = out.mapInArrow(trimmed, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=False)), more]))
    return made.toDF(*keep, *made.columns[len(keep) :])
