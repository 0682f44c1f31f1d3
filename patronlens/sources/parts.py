"""A stage table that follows its source files: only what was added or changed is read again.

Below the table's folder, ``rows-<id>`` holds the rows of one refresh with the file that each
came from, and ``manifest-<number>`` lists which file, in which state, has its rows where.  A
file's state is a digest of its path, length, modification time and the settings it is read with.
The newest manifest whose write came to its end is the table; a refresh that breaks off leaves the one
before in place.  Listing, comparing and writing are Spark jobs; the driver sees the names of
the files to read, which the reader needs anyway.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronlens.sources.stages import hadoop_path, is_complete, stage

SOURCE = "source_file"
_MANIFEST = f"{SOURCE} string, state string, rows_in string"


@dataclass(frozen=True)
class Refreshed:
    """The rows of all files (with the column ``source_file``), and how many files each fared how."""

    rows: DataFrame
    added: int
    changed: int
    removed: int
    unchanged: int


def source_states(spark: SparkSession, paths: str | Sequence[str], settings: Mapping[str, object] | None = None) -> DataFrame:
    """``source_file, state`` of every file that ``paths`` (globs allowed) name; no file is opened."""
    known = json.dumps(settings or {}, sort_keys=True, default=str)
    meta = F.col("_metadata")
    try:
        files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{SOURCE} string, state string")
    parts = [meta["file_path"], meta["file_size"], meta["file_modification_time"].cast("double"), F.lit(known)]
    state = F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
    return files.select(meta["file_path"].alias(SOURCE), state.alias("state"))


def refresh(
    spark: SparkSession,
    path: str,
    sources: str | Sequence[str],
    build: Callable[[list[str]], DataFrame],
    *,
    settings: Mapping[str, object] | None = None,
) -> Refreshed:
    """Bring the table at ``path`` up to its source files and return it.

    ``build`` gets the files to read and returns rows with the column ``source_file`` as
    ``_metadata.file_path`` names it.  ``settings`` should say all that its result depends on: the
    schema, reader options, a version of the code.  Files that change while they are read are an error.
    Rows of files that changed or went away are left out by a join on file names, and their
    folders are removed once no file uses them.
    """
    number, before = _manifest(spark, path)
    now = stage(source_states(spark, sources, settings), "states")
    old = before.select(SOURCE, F.col("state").alias("old"), "rows_in")
    both = stage(now.join(old, SOURCE, "full"), "states")
    counts = both.agg(
        F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("state").isNull()).alias("removed"),
        F.count_if(F.col("old") != F.col("state")).alias("changed"), F.count_if(F.col("old") == F.col("state")).alias("unchanged"),
    ).first()
    if not number or counts["added"] or counts["changed"] or counts["removed"]:
        fresh = both.where("state is not null and (old is null or old <> state)")
        files = [unquote(r[0]) for r in fresh.select(SOURCE).collect()]
        name = f"rows-{uuid.uuid4().hex}"
        if files:
            build(files).write.parquet(f"{path}/{name}")
            if not fresh.join(source_states(spark, files, settings), [SOURCE, "state"], "left_anti").isEmpty():
                raise RuntimeError("source files changed while they were read; refresh again")
        kept = both.where("old = state").select(SOURCE, "state", "rows_in")
        listed = kept.unionByName(fresh.select(SOURCE, "state", F.lit(name).alias("rows_in")))
        listed.coalesce(1).write.parquet(f"{path}/manifest-{number + 1:08d}")
        _remove_unused(spark, path, number + 1, listed)
    return Refreshed(read_parts(spark, path), **counts.asDict())


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files of the newest manifest."""
    number, listed = _manifest(spark, path)
    folders = sorted(r[0] for r in listed.select("rows_in").distinct().collect())
    if not folders:
        raise FileNotFoundError(f"no source file has rows in {path}")
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{path}/{f}" for f in folders])
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(rows-[0-9a-f]+)/", 1)
    columns = rows.columns
    live = listed.select(SOURCE, "rows_in")
    return rows.withColumn("rows_in", folder).join(live, [SOURCE, "rows_in"], "left_semi").select(*columns)


def _entries(spark: SparkSession, path: str, pattern: str) -> list[str]:
    files, at = hadoop_path(spark, path)
    if not files.exists(at):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(at)) if re.fullmatch(pattern, n))


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number and rows of the newest complete manifest; 0 and none if there is none."""
    for name in reversed(_entries(spark, path, r"manifest-\d+")):
        if is_complete(spark, f"{path}/{name}"):
            return int(name.split("-")[1]), spark.read.schema(_MANIFEST).parquet(f"{path}/{name}")
    return 0, spark.createDataFrame([], _MANIFEST)


def _remove_unused(spark: SparkSession, path: str, number: int, listed: DataFrame) -> None:
    """Folders that neither this manifest nor the one before uses, and older manifests."""
    used = {r[0] for r in listed.select("rows_in").distinct().collect()}
    earlier = f"manifest-{number - 1:08d}"
    if is_complete(spark, f"{path}/{earlier}"):
        used |= {r[0] for r in spark.read.parquet(f"{path}/{earlier}").select("rows_in").distinct().collect()}
    for name in _entries(spark, path, r"manifest-\d+|rows-[0-9a-f]+"):
        old = int(name.split("-")[1]) < number - 1 if name.startswith("manifest") else name not in used
        if old:
            files, at = hadoop_path(spark, f"{path}/{name}")
            files.delete(at, True)
