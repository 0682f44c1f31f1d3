"""Profiles of a line or customer table, each from one pass over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from patronlens.functions.columns import is_missing, month_of
from patronlens.functions.quantiles import exact_quantiles
from patronlens.operators.shaping import unpivot


def preview(df: DataFrame, key: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in key order (rows of a distributed table have no other order)."""
    return df.orderBy(*key).limit(rows)


def shape_and_range(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(lines.columns)).cast("long").alias("columns"),
        F.min("InvoiceDate").alias("first_date"),
        F.max("InvoiceDate").alias("last_date"),
    )


def schema_listing(df: DataFrame) -> DataFrame:
    """Position, name, type and number of non-null values of every column, from one pass."""
    counts = [F.count(F.col(name)).alias(name) for name in df.columns]
    entries = [(F.lit(i), F.lit(name), F.lit(kind), F.col(name)) for i, (name, kind) in enumerate(df.dtypes, 1)]
    return unpivot(df.agg(*counts), ["position", "column", "type", "non_null"], entries)


def missing_counts(df: DataFrame) -> DataFrame:
    counts = [F.count_if(is_missing(F.col(name), kind)).alias(name) for name, kind in df.dtypes]
    return unpivot(df.agg(*counts), ["column", "missing"], [(F.lit(c), F.col(c)) for c in df.columns])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact interpolated quartiles per column.

    Reads ``df`` twice: once for the moments, once to count its different values.
    """
    numbers = df.select(*[F.when(~F.isnan(v), v).alias(c) for c in columns for v in [F.col(c).cast("double")]])
    quartiles = exact_quantiles(numbers, {c: [0.25, 0.5, 0.75] for c in columns})
    aggregates, entries = [], []
    for c in columns:
        statistics = {
            "count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c),
        }
        aggregates += [a.alias(f"{c}_{name}") for name, a in statistics.items()]
        before = [F.col(f"{c}_{name}") for name in ("count", "mean", "std", "min")]
        edges = [F.lit(q).cast("double") for q in quartiles[c]]
        entries.append((F.lit(c), *before, *edges, F.col(f"{c}_max")))
    names = ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return unpivot(numbers.agg(*aggregates), names, entries)


def business_summary(clean: DataFrame) -> DataFrame:
    """Customers, invoices, revenue and time range of clean lines.

    Two distinct counts in one aggregate would expand every line twice.  Counting
    per (customer, invoice) pair first shrinks the lines on the map side, and what
    is left is one row per invoice.
    """
    invoices = clean.groupBy("CustomerID", "InvoiceNo").agg(
        F.sum("TotalPrice").alias("revenue"),
        F.min("InvoiceDate").alias("first_date"),
        F.max("InvoiceDate").alias("last_date"),
    )
    return invoices.agg(
        F.count_distinct("CustomerID").alias("customers"),
        F.count_distinct("InvoiceNo").alias("invoices"),
        F.sum("revenue").alias("revenue"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def top_countries(lines: DataFrame, k: int = 10) -> DataFrame:
    """Countries with the most lines; equal counts go by name.  Missing countries do not rank."""
    return (
        lines.where(F.col("Country").isNotNull())
        .groupBy("Country")
        .agg(F.count(F.lit(1)).alias("lines"))
        .orderBy(F.desc("lines"), "Country")
        .limit(k)
    )


def monthly_revenue(clean: DataFrame) -> DataFrame:
    return (
        clean.groupBy(month_of(F.col("InvoiceDate")).alias("month"))
        .agg(F.sum("TotalPrice").alias("revenue"))
        .orderBy("month")
    )
