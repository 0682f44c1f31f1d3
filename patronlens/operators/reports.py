"""Reports on clusters and segments: one row per cluster or segment.

Shares and ranks are taken over the aggregated rows only, never over customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.functions.columns import half_even, share
from patronlens.operators.segments import cluster_means, rank_names, ranked_strategy
from patronlens.schemas import CUSTOMER, RFM

def _total(column: str) -> Column:
    return F.sum(column).over(Window.partitionBy())


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("Cluster").agg(F.count(F.lit(1)).alias("customers")).orderBy("Cluster")


def cluster_shares(clustered: DataFrame) -> DataFrame:
    return (
        cluster_sizes(clustered)
        .withColumn("pct_customers", share(F.col("customers"), _total("customers")))
        .orderBy("Cluster")
    )


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Mean (two digits) and count of each measure per cluster."""
    return (
        clustered.groupBy("Cluster")
        .agg(
            *[half_even(F.avg(c), 2).alias(f"{c}_mean") for c in RFM],
            *[F.count(c).alias(f"{c}_count") for c in RFM],
        )
        .orderBy("Cluster")
    )


def cluster_revenue(clustered: DataFrame) -> DataFrame:
    """Customers, revenue and its share per cluster, largest revenue first."""
    return (
        clustered.groupBy("Cluster")
        .agg(F.count(F.lit(1)).alias("Count"), F.sum("Monetary").alias("Revenue"))
        .withColumn("Pct", share(F.col("Revenue"), _total("Revenue")))
        .orderBy(F.desc("Revenue"), "Cluster")
    )


def segment_summary(named: DataFrame) -> DataFrame:
    """Size, mean measures and revenue per segment, with shares of the rounded totals."""
    rounded = named.groupBy("Segment_Name").agg(
        F.count(F.lit(1)).alias("Count"),
        *[half_even(F.avg(c), 2).alias(f"Avg_{c}") for c in RFM],
        half_even(F.sum("Monetary"), 2).alias("Total_Revenue"),
    )
    shares = {
        "Pct_Customers": half_even(share(F.col("Count"), _total("Count")), 1),
        "Pct_Revenue": half_even(share(F.col("Total_Revenue"), _total("Total_Revenue")), 1),
    }
    return rounded.withColumns(shares).orderBy(F.desc("Pct_Revenue"), "Segment_Name")


def radar_profile(customers: DataFrame, by: str, *, recency_scale: str = "two_down") -> DataFrame:
    """Mean of each measure relative to its maximum, per cluster or segment.

    F and M run from 1 to 5.  R falls with recency: from 2 to -2 by default, or from
    5 to 1 with ``recency_scale="one_to_five"``.  A maximum of zero gives NULL.
    """
    tops = {"two_down": 2.0, "one_to_five": 5.0}
    if recency_scale not in tops:
        raise ValueError(f"recency_scale must be one of {list(tops)}, got {recency_scale!r}")
    top = customers.agg(F.struct(*[F.max(c).alias(c) for c in RFM]).alias("top")).scalar()
    relative = {c: F.col(c) / F.nullif(top[c], F.lit(0)) * 4.0 for c in RFM}
    axes = {
        "R": F.lit(tops[recency_scale]) - relative["Recency"],
        "F": relative["Frequency"] + 1.0,
        "M": relative["Monetary"] + 1.0,
    }
    return (
        customers.select(by, *[axis.alias(name) for name, axis in axes.items()])
        .groupBy(by)
        .agg(*[half_even(F.avg(name), 2).alias(name) for name in axes])
        .orderBy(by)
    )


def strategy_report(clustered: DataFrame, strategy: DataFrame | None = None) -> DataFrame:
    """Cluster, its segment by rank of mean spend, size, revenue, share, action and impact.

    ``strategy`` may replace the built-in texts: Segment, Strategy, Expected_Impact.
    """
    strategy = ranked_strategy(clustered.sparkSession) if strategy is None else strategy
    names = rank_names(cluster_means(clustered))
    return (
        cluster_revenue(clustered)
        .join(F.broadcast(names), "Cluster")
        .join(strategy, "Segment", "left")
        .select(
            "Cluster",
            "Segment",
            F.col("Count").alias("Customers"),
            half_even(F.col("Revenue"), 2).alias("Revenue"),
            half_even(F.col("Pct"), 2).alias("Revenue_Share_%"),
            "Strategy",
            "Expected_Impact",
        )
        .orderBy(F.desc("Revenue"), "Cluster")
    )


def scatter_points(named: DataFrame) -> DataFrame:
    """What a three-dimensional scatter plot of customers draws."""
    return named.select(CUSTOMER, *RFM, "Segment_Name")


def scatter_sample(named: DataFrame, per_segment: int = 500, seed: int = 42) -> DataFrame:
    """At most ``per_segment`` customers of every segment: those with the smallest keyed hashes.

    The draw is the MD5 of ``<seed>:<CustomerID>``, so partitioning does not matter; equal draws go by
    the id's text.  Counts of the draws' first four digits, added up on the map side, tell which draws
    can be among the smallest; only these rows are shuffled and ranked, for any ``per_segment``.  A
    missing segment is a segment of its own.  A customer without an id is not drawn.
    """
    drawn = scatter_points(named).where(F.col(CUSTOMER).isNotNull()).withColumns({
        "__id": F.col(CUSTOMER).cast("string"),
        "__draw": F.md5(F.concat(F.lit(f"{seed}:"), F.col(CUSTOMER).cast("string"))),
    }).withColumn("__head", F.substring("__draw", 1, 4))
    heads = drawn.groupBy("Segment_Name", "__head").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("Segment_Name").orderBy("__head")) - F.col("n")
    reach = (
        heads.withColumn("before", before).where(F.col("before") < per_segment)
        .groupBy("Segment_Name").agg(F.max("__head").alias("__reach")).withColumnRenamed("Segment_Name", "__segment")
    )
    near = drawn.join(reach, F.col("Segment_Name").eqNullSafe(F.col("__segment"))).where(F.col("__head") <= F.col("__reach"))
    order = Window.partitionBy("Segment_Name").orderBy("__draw", "__id")
    return near.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= per_segment).select(
        CUSTOMER, *RFM, "Segment_Name"
    )
