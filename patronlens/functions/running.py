"""Running totals over a total order, in as many tasks as the rows need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.sources.stages import stage


def running_totals(
    rows: DataFrame, order: Sequence[Column | str], value: Column, name: str, *, within: Sequence[str] = ()
) -> DataFrame:
    """All rows with ``name``: the sum of ``value`` over the rows before them, in each group of ``within``.

    Rows are dealt by ranges of ``order`` (which starts with ``within``), each range is summed on its
    own, and the totals of the ranges before are added: one row for a range and group, so neither
    the whole table nor a hot group passes through one task.  Values are whole numbers; rows that tie
    in ``order`` stand in any order, but always in one range.
    """
    ranged = rows.withColumn("value ", value.cast("long")).repartitionByRange(*order)
    ranged = stage(ranged.withColumn("range ", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*within).orderBy("range ").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*within, "range ").agg(F.sum("value ").alias("total "))
    offsets = totals.select(
        *[F.col(c).alias(f"{c} of") for c in within], F.col("range ").alias("of "),
        F.coalesce(F.sum("total ").over(earlier), F.lit(0)).alias("offset "),
    )
    inside = Window.partitionBy(*within, "range ").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("range ") == F.col("of ")
    for column in within:
        match &= F.col(column).eqNullSafe(F.col(f"{column} of"))
    return (
        ranged.withColumn(name, F.coalesce(F.sum("value ").over(inside), F.lit(0)))
        .join(offsets, match)
        .withColumn(name, F.col(name) + F.col("offset "))
        .select(*[c for c in rows.columns if c != name], name)
    )
