"""The recency / frequency / monetary table, one row per customer."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from patronlens.functions.columns import wall_clock, whole_days
from patronlens.schemas import CUSTOMER, RFM
from patronlens.sources.stages import stage

#: Logarithm of the registers of an invoice sketch.
SKETCH_PRECISION = 12


def customer_totals(clean: DataFrame) -> DataFrame:
    """Last purchase, distinct invoices and spend per customer.

    Spark aggregates by (customer, invoice) before and after the first shuffle and
    only then by customer, so a customer with a third of all lines is spread over
    all tasks until little of it is left.
    """
    return clean.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER).agg(
        F.max("InvoiceDate").alias("LastPurchase"),
        F.count_distinct("InvoiceNo").alias("Frequency"),
        F.sum("TotalPrice").alias("Monetary"),
    )


def invoice_totals(clean: DataFrame, *by: str) -> DataFrame:
    """Last purchase and spend per customer and invoice, for each value of the columns ``by``.

    Totals of different parts of the lines can be stacked: ``merged_totals`` makes one of them.
    """
    return clean.where(F.col(CUSTOMER).isNotNull()).groupBy(*by, CUSTOMER, "InvoiceNo").agg(
        F.max("InvoiceDate").alias("LastPurchase"), F.sum("TotalPrice").alias("Monetary")
    )


def merged_totals(invoices: DataFrame) -> DataFrame:
    """The totals of ``customer_totals`` from stacked ``invoice_totals``; an invoice may stand in several parts."""
    return invoices.groupBy(CUSTOMER).agg(
        F.max("LastPurchase").alias("LastPurchase"),
        F.count_distinct("InvoiceNo").alias("Frequency"),
        F.sum("Monetary").alias("Monetary"),
    )


def monthly_sketches(clean: DataFrame, *, precision: int = SKETCH_PRECISION) -> DataFrame:
    """Per customer and month: last purchase, spend and a sketch of the invoice numbers.

    Sketches of any months merge, so an invoice that stands in two of them counts once.
    ``precision`` is the logarithm of a sketch's registers: the standard error of a count is about
    1.04 / sqrt(2 ** precision), 1.6 % for 12; counts up to a few hundred come out exact in practice.
    """
    month = F.date_format("InvoiceDate", "yyyy-MM").alias("Month")
    return clean.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER, month).agg(
        F.max("InvoiceDate").alias("LastPurchase"),
        F.hll_sketch_agg("InvoiceNo", precision).alias("Invoices"),
        F.sum("TotalPrice").alias("Monetary"),
    )


def totals_of_months(sketches: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The totals of ``customer_totals`` over the months from ``first`` to ``last``, with Frequency estimated.

    Give the result to ``rfm_of_totals``.  Lines without a date belong to no month and are left out of bounded periods.
    """
    if first is not None:
        sketches = sketches.where(F.col("Month") >= first)
    if last is not None:
        sketches = sketches.where(F.col("Month") <= last)
    return sketches.groupBy(CUSTOMER).agg(
        F.max("LastPurchase").alias("LastPurchase"),
        F.hll_sketch_estimate(F.hll_union_agg("Invoices")).alias("Frequency"),
        F.sum("Monetary").alias("Monetary"),
    )


def snapshot_after(totals: DataFrame) -> datetime | None:
    """One day after the last purchase of anyone.

    Taken from the per-customer table, so the lines are not scanned a second time.
    """
    last = totals.agg(F.max("LastPurchase").alias("last")).first()["last"]
    return last + timedelta(days=1) if last else None


def build_rfm(clean: DataFrame, snapshot: datetime | None = None) -> DataFrame:
    """CustomerID, Recency (whole days), Frequency (invoices), Monetary (spend).

    The per-customer totals become a stage table: they are read for the snapshot
    date, for every quantile and for the scores, all of which must see the same sums.
    """
    return rfm_of_totals(customer_totals(clean), snapshot)


def rfm_of_totals(totals: DataFrame, snapshot: datetime | None = None) -> DataFrame:
    """The same from totals per customer."""
    totals = stage(totals, "customer-totals")
    snapshot = snapshot_after(totals) if snapshot is None else snapshot
    if snapshot is None:
        raise ValueError("no clean lines with a date: there is nothing to measure recency from")
    recency = whole_days(F.col("LastPurchase"), wall_clock(snapshot)).alias("Recency")
    return totals.select(CUSTOMER, recency, *RFM[1:])
