"""Files and intermediate tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only on a single
machine, where that may be unset (tests), is a folder of our own used.  Lineage is cut by
writing a table there, so a lost executor costs no recomputation of what came before, and
no block lives on one machine only.  An application has a folder of its own in it, which
is removed when it ends; what a step needs only itself is removed when the step is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Used only on a single machine that names no shared folder.
OWN_FOLDER = "file:///tmp/checkpoints"
_APPLICATIONS: set[str] = set()
_SCRATCH: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of this application's folder in the shared one, with a scheme and no slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = (named or OWN_FOLDER).rstrip("/")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    own = f"{root}/tables-{spark.sparkContext.applicationId}"
    if own not in _APPLICATIONS:
        path, system = _file_system(spark, own)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _APPLICATIONS.add(own)
    return own


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it; for executors, which have no JVM gateway."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def dealt_files(df: DataFrame, at: str, name: str) -> str:
    """``df`` written as a folder of Parquet files for each value of its column ``at``, which tasks read by ``part_of``."""
    path = new_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.repartition(at).write.partitionBy(at).parquet(path)
    return f"{path}/{at}="


def part_of(files: str, value: int) -> pa.Table:
    """The rows of ``dealt_files`` with this value; called by tasks."""
    fs, path = filesystem(f"{files}{value}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return pa.table({})
    return ds.dataset(path, format="parquet", filesystem=fs, partitioning=None).to_table(use_threads=False)


def _file_system(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str, last: bool = False) -> str:
    """A path in the shared folder that nothing else uses; within ``scratch`` one that goes with it, unless ``last``."""
    folders = _SCRATCH[:-1] if last else _SCRATCH
    return f"{folders[-1] if folders else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run in the meantime go when their query is done: what was written is read from its files.

    Else they stay until the driver happens to collect its garbage, and those of all steps lie on disk together.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; ``last``: it outlives the innermost ``scratch``."""
    path = new_path(df.sparkSession, name, last)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in the meantime are removed at the end; what is to stay is written as ``last``."""
    folder = new_path(spark, "scratch")
    _SCRATCH.append(folder)
    try:
        yield
    finally:
        _SCRATCH.remove(folder)
        path, system = _file_system(spark, folder)
        system.delete(path, True)
