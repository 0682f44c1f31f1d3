"""CSV exports: small report files and size-bounded line chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.functions.running import running_totals
from patronlens.sources.stages import stage

_BYTE_ORDER_MARK = "﻿"
# Files are planned for this share of the bound, because rows differ in length.
_FILLED = 0.85
# A file is written by one task, so it holds no more than a usual split of input.
TASK_BYTES = 128 * 1024 * 1024


def write_report_csv(report: DataFrame, path: str, *, byte_order_mark: bool = True) -> None:
    """One CSV file for a report of a few rows (one per segment).

    The byte order mark rides on the first header name, so spreadsheet programs
    read the UTF-8 text correctly.
    """
    first, *_ = report.columns
    named = report.withColumnRenamed(first, _BYTE_ORDER_MARK + first) if byte_order_mark else report
    named.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _row_bytes(lines: DataFrame) -> Column:
    """Size of a row as CSV text with its line feed."""
    return F.octet_length(F.to_csv(F.struct(*lines.columns), {"escape": '"'})) + 1


def csv_bytes(lines: DataFrame) -> int:
    """Size of all rows as CSV text, without headers."""
    return lines.agg(F.sum(_row_bytes(lines))).first()[0] or 0


def write_csv_chunks(lines: DataFrame, path: str, *, chunk_bytes: int = 20 * 1024 * 1024) -> int:
    """Write every row as CSV files of at most about ``chunk_bytes`` each; returns the number of files.

    One task writes a file, so files are planned for ``TASK_BYTES`` where ``chunk_bytes`` allows
    more: tasks grow in number with the lines, not in size.  The lines are staged once, measured
    as a whole and dealt out in turn, so long rows spread over all files wherever they stood.
    """
    staged = stage(_with_text_times(lines), "csv-lines")
    files = max(-int(-csv_bytes(staged) // (min(chunk_bytes, TASK_BYTES) * _FILLED)), 1)
    staged.repartition(files).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return files


def write_ordered_chunks(
    lines: DataFrame, path: str, order: Sequence[str], *, chunk_bytes: int = 20 * 1024 * 1024
) -> int:
    """Write every row as CSV files in the order of the columns ``order``; returns the number of files.

    Folder ``chunk=<n>`` holds one file; every row of it stands before every row of the next, and no
    file, with its header, is larger than ``chunk_bytes``.  A single row that does not fit is an error.
    Rows that tie in ``order`` stand in any order, next to each other.  Where a row belongs follows
    from the bytes before it, which are summed by ranges of the order: no task sees more than a range.
    """
    texts = _with_text_times(lines)
    header = len((",".join(texts.columns) + "\n").encode())
    sized = stage(texts.withColumn("bytes ", _row_bytes(texts).cast("long")), "csv-lines")
    longest = sized.agg(F.max("bytes ")).first()[0]
    if longest is None:
        return 0
    if header + longest > chunk_bytes:
        raise ValueError(f"a row of {longest} bytes and its header do not fit into {chunk_bytes} bytes")
    # A chunk holds the rows that begin in its share of all bytes, so it ends at most one row beyond it.
    share = max(chunk_bytes - header - longest, 1)
    placed = running_totals(sized, order, F.col("bytes "), "before ")
    placed = stage(placed.withColumn("chunk", F.floor(F.col("before ") / share)).drop("bytes ", "before "), "csv-lines")
    numbers = placed.select("chunk").distinct()
    dense = running_totals(numbers, ["chunk"], F.lit(1), "number ")
    placed = placed.join(dense, "chunk").withColumn("chunk", F.format_string("%08d", "number ")).drop("number ")
    writer = placed.repartition("chunk").sortWithinPartitions("chunk", *order).write
    # Tasks put their own files in place: one folder a chunk is too many for the driver to move in turn.
    moved = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    moved.mode("overwrite").partitionBy("chunk").option("header", True).option("escape", '"').csv(path)
    return numbers.count()


def _with_text_times(lines: DataFrame) -> DataFrame:
    """Time stamps as plain text, with a fraction of a second only where there is one."""
    times = [name for name, kind in lines.dtypes if kind.startswith("timestamp")]
    return lines.withColumns({c: F.col(c).cast("string") for c in times})
