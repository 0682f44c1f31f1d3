"""Cleaning rules for retail lines and the audit of what each rule removes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.functions.columns import above_zero, not_cancelled, is_missing
from patronlens.operators.shaping import unpivot


def has_customer(lines: DataFrame) -> Column:
    return ~is_missing(F.col("CustomerID"), dict(lines.dtypes)["CustomerID"])


def cleaning_rules(lines: DataFrame) -> dict[str, Column]:
    """The rules in the order they apply; each keeps the rows it is true for."""
    return {
        "has_customer": has_customer(lines),
        "not_cancelled": not_cancelled(F.col("InvoiceNo")),
        "positive_amount": above_zero(F.col("Quantity")) & above_zero(F.col("UnitPrice")),
    }


def clean_lines(lines: DataFrame) -> DataFrame:
    """Valid sales with a whole-number customer and the line total.

    Equal lines are all kept: selling the same article twice is not an error.
    """
    kept = reduce(DataFrame.where, cleaning_rules(lines).values(), lines)
    return kept.withColumns(
        {
            "CustomerID": F.col("CustomerID").cast("long"),
            "TotalPrice": F.col("Quantity") * F.col("UnitPrice"),
        }
    )


def cleaning_audit(lines: DataFrame) -> DataFrame:
    """Rows before and after each rule, counted in a single pass."""
    rules = cleaning_rules(lines)
    names, predicates = list(rules), list(rules.values())
    counts = [F.count(F.lit(1)).alias("left_0")] + [
        F.count_if(reduce(and_, predicates[: i + 1])).alias(f"left_{i + 1}") for i in range(len(rules))
    ]
    before, after = (lambda i: F.col(f"left_{i}")), (lambda i: F.col(f"left_{i + 1}"))
    return unpivot(
        lines.agg(*counts),
        ["step", "rule", "rows_before", "rows_after", "rows_removed"],
        [(F.lit(i + 1), F.lit(name), before(i), after(i), before(i) - after(i)) for i, name in enumerate(names)],
    )
