"""Small helpers that turn wide aggregate rows into report rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def unpivot(row: DataFrame, names: Sequence[str], entries: Sequence[Sequence[Column]]) -> DataFrame:
    """One output row per entry for every input row; ``names`` are the output columns."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(entry, names, strict=True)]) for entry in entries]
    return row.select(F.inline(F.array(*structs)))


def dimension(spark: SparkSession, **columns: list) -> DataFrame:
    """A fixed handful of rows as a local relation, so its size is known to the planner."""
    return spark.createDataFrame(pa.table(columns))
