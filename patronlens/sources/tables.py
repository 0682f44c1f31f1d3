"""Retail lines and purchases taken from order tables (lineitem, orders, part, events)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronlens import schemas


# The columns used here; with a given schema no job reads file footers first.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def order_lines(
    spark: SparkSession, folder: str, columns: Sequence[str] = tuple(schemas.LINE_COLUMNS)
) -> DataFrame:
    """Retail lines out of lineitem, orders, part and, for the country, customer and nation.

    A returned line counts as cancelled.  The country is joined to the orders, not
    to the far more numerous lines, and only when asked for.  The invoice number
    comes from the line's own key so that the cancellation filter reaches the
    lineitem scan.  Joins carry no hints: sizes decide, and adaptive execution
    splits a hot order or part.
    """
    orders = table(spark, folder, "orders")
    if "Country" in columns:
        home = (
            table(spark, folder, "customer")
            .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "n_name")
        )
        orders = orders.join(home, F.col("o_custkey") == F.col("c_custkey"), "left")
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    part = table(spark, folder, "part")
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))

    number = F.col("l_orderkey").cast("string")
    made = {
        "InvoiceNo": F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C"), number)).otherwise(number),
        "StockCode": F.col("l_partkey").cast("string"),
        "Description": F.col("p_name"),
        "Quantity": F.col("l_quantity"),
        "InvoiceDate": F.col("o_orderdate"),
        "UnitPrice": F.col("p_retailprice"),
        "CustomerID": F.col("o_custkey"),
    }
    if "Country" in columns:
        made["Country"] = F.col("n_name")
    return lines.select(*[made[c].alias(c) for c in columns])


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as clean lines; their time stamps carry a time of day."""
    return (
        table(spark, folder, "events")
        .where((F.col("event_type") == "purchase") & (F.col("value") > 0) & ~F.isnan("value"))
        .select(
            F.col("user_id").alias("CustomerID"),
            F.col("event_id").cast("string").alias("InvoiceNo"),
            F.col("ts").alias("InvoiceDate"),
            F.col("value").alias("TotalPrice"),
        )
    )
