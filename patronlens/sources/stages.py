"""Stage tables: written once, read many times, safe against lost executors.

A stage that several later steps read is written as Parquet into shared storage.
Reading it back costs a pruned columnar scan, never a rerun of the steps before
it, and rerun tasks see exactly the same floating point sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Scratch folders already marked for removal.
_marked: set[str] = set()
# Paths of the stage tables made in each open scope, outermost first.
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else the session's warehouse folder.

    A warehouse on a local disk will do for a local session only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir", None) or ""
        local = spark.conf.get("spark.master", "").split("[")[0] == "local"
        if not root or (not local and (root.startswith("file:") or "://" not in root)):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def new_stage_path(spark: SparkSession, name: str) -> str:
    """A new place for a scratch table, in a folder that is removed when the session's process ends."""
    scratch = f"{stage_root(spark)}/patronlens/{spark.sparkContext.applicationId}"
    if scratch not in _marked:
        files, folder = hadoop_path(spark, scratch)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _marked.add(scratch)
    return f"{scratch}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Stage tables made inside are removed at the end, but for those written with the function this yields.

        with released() as keep:
            counts = stage(count(rows), "counts")
            result = keep(join(counts, rows), "result")   # written before the counts go

    What is kept belongs to the scope around this one.  Nothing that is read later may depend
    on a removed table: hand out kept tables only.
    """
    outer, own = _scopes.get(), []
    token = _scopes.set((*outer, own))

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _scopes.set(outer)
        try:
            return stage(df, name)
        finally:
            _scopes.reset(inside)

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for spark, path in own:
            files, at = hadoop_path(spark, path)
            files.delete(at, True)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its form."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new stage table and continue from the written copy."""
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    if scopes := _scopes.get():
        scopes[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Replace the named stage table and continue from the written copy."""
    df.write.mode("overwrite").parquet(path)
    return read_stage(df.sparkSession, path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write of the table came to its end and left its marker."""
    files, marker = hadoop_path(spark, f"{path.rstrip('/')}/_SUCCESS")
    return files.exists(marker)


def read_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], *, rebuild: bool = False
) -> DataFrame:
    """The stage table at ``path`` if a write of it was completed, else built, written and read back.

    Nothing checks whether the sources changed since: pass ``rebuild=True`` then, or let
    ``parts.refresh`` follow the source files.
    """
    if not rebuild and is_complete(spark, path):
        return read_stage(spark, path)
    return write_stage(build(), path)
