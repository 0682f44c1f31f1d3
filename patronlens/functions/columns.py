"""Column expressions: all JVM-side, no Python functions on rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, functions as F


def is_missing(column: Column, data_type: str = "string") -> Column:
    """True for NULL, and for NaN where the type can hold one."""
    if data_type in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def above_zero(column: Column) -> Column:
    """``column > 0`` with NaN not above zero; as a filter it drops NULL too.

    Spark orders NaN above every number, so a bare ``> 0`` would keep it.
    """
    return (column > 0) & ~F.isnan(column.cast("double"))


def not_cancelled(invoice: Column) -> Column:
    """Cancelled invoices start with a capital C; a missing number is not cancelled.

    Written as OR, not with ``coalesce``, so that a Parquet scan can use it.
    """
    text = invoice.cast("string")
    return text.isNull() | ~F.startswith(text, F.lit("C"))


def wall_clock(moment: datetime) -> Column:
    """A time stamp without zone.  A bare literal would be an instant and shift with the session zone."""
    return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down also when end lies before start.

    Subtracting two NTZ timestamps does not depend on the session time zone, as
    date arithmetic on zoned timestamps would.
    """
    gap = end - start
    days = F.extract(F.lit("DAY"), gap)
    return (days - (gap < F.make_dt_interval(days)).cast("int")).cast("long")


def half_even(column: Column, digits: int) -> Column:
    """Round half to even on the scaled binary value.

    ``bround`` decides on the decimal text of the number, so 1.255 becomes 1.26
    there, while array libraries scale first and get 1.25.
    """
    factor = float(10**digits)
    return F.rint(column * factor) / factor


def blank_to_null(column: Column, tokens: Sequence[str]) -> Column:
    return F.when(~column.isin(list(tokens)), column)


def month_of(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM")


def share(part: Column, whole: Column) -> Column:
    """Percentage, NULL when there is no whole."""
    return part / F.nullif(whole, F.lit(0)) * 100.0
