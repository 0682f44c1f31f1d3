"""Names for clusters, and the marketing texts that go with the names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from patronlens.operators.shaping import dimension
from patronlens.schemas import RFM

# Segment names by rank of mean spend.
RANK_NAMES = ["Champions", "Loyal", "New", "Hibernating"]

# Segment names by rule, and the name when no rule holds.
RULE_NAMES = ["Champions", "At-Risk VIP", "New Customers", "Hibernating"]
OTHER_NAME = "Regular"

# What a rank of mean spend means for a shop: (aim, first step).  Impacts are the user's own estimates.
RANKED_STRATEGY = {
    "Champions": ("keep", "ask what they would miss, and never let their favourites run out of stock"),
    "Loyal": ("extend", "offer the category that goes with what they buy most"),
    "New": ("learn", "find out what brought them before writing to them again"),
    "Hibernating": ("decide", "send one message; stop mailing those who do not open it"),
}

# The rule behind each name, in words, and the steps that follow from it.
RULED_STRATEGY = {
    "Champions": {
        "rule": "mean spend above the third quartile, last purchase before the first quartile of days",
        "steps": ["reserve stock ahead of launches", "ask for reviews"],
    },
    "At-Risk VIP": {
        "rule": "mean spend above the third quartile, last purchase after the third quartile of days",
        "steps": ["check open complaints and returns first", "write from a named person", "note the reason for leaving"],
    },
    "New Customers": {
        "rule": "last purchase before the first quartile of days, fewer orders than the median",
        "steps": ["confirm that the first order was right", "show how reordering works"],
    },
    "Hibernating": {
        "rule": "last purchase after the third quartile of days",
        "steps": ["one seasonal reminder a year"],
    },
    "Regular": {
        "rule": "none of the other rules",
        "steps": ["usual newsletter", "watch for a change of rule"],
    },
}


def cluster_means(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in RFM])


def rank_names(means: DataFrame) -> DataFrame:
    """Cluster, rank of its mean spend and the name for that rank.

    Four clusters take the four names in order.  With fewer or more, the first is
    Champions, the last Hibernating, the second Loyal from three clusters on, and
    any others are New.  The windows run over one row per cluster.
    """
    first, second, middle, last = RANK_NAMES
    rank, k = F.col("spend_rank"), F.count(F.lit(1)).over(Window.partitionBy())
    name = (
        F.when(rank == 1, F.lit(first))
        .when(rank == k, F.lit(last))
        .when(rank == 2, F.lit(second))
        .otherwise(F.lit(middle))
    )
    by_spend = Window.orderBy(F.desc("Monetary"), "Cluster")
    return means.select("Cluster", "Monetary", F.row_number().over(by_spend).alias("spend_rank")).select(
        "Cluster", "spend_rank", name.alias("Segment")
    )


def rule_names(means: DataFrame, quartiles: Mapping[str, Sequence[float]]) -> DataFrame:
    """Cluster and the name of the first rule its means satisfy; names may repeat.

    ``quartiles`` are those of the customers, as from ``quantile_thresholds``.
    """
    (r25, _, r75), (_, f50, _), (_, _, m75) = (map(F.lit, quartiles[c]) for c in RFM)
    recent, absent = F.col("Recency") < r25, F.col("Recency") > r75
    seldom, rich = F.col("Frequency") < f50, F.col("Monetary") > m75
    rules = [rich & recent, rich & absent, recent & seldom, absent]
    name = F.when(rules[0], F.lit(RULE_NAMES[0]))
    for rule, text in zip(rules[1:], RULE_NAMES[1:]):
        name = name.when(rule, F.lit(text))
    return means.withColumn("Segment_Name", name.otherwise(F.lit(OTHER_NAME)))


def name_segments(clustered: DataFrame, names: DataFrame) -> DataFrame:
    """Attach Segment_Name to every customer; ``names`` has one row per cluster."""
    return clustered.join(F.broadcast(names.select("Cluster", "Segment_Name")), "Cluster", "left")


def ranked_strategy(spark: SparkSession, impacts: Mapping[str, str] | None = None) -> DataFrame:
    """Segment, Strategy and Expected_Impact; the last is what ``impacts`` says, else NULL."""
    table = dimension(
        spark,
        Segment=list(RANKED_STRATEGY),
        Strategy=[f"{aim}: {step}" for aim, step in RANKED_STRATEGY.values()],
        impact=[(impacts or {}).get(name, "") for name in RANKED_STRATEGY],
    )
    return table.select("Segment", "Strategy", F.expr("nullif(impact, '')").alias("Expected_Impact"))


def strategy_matrix(spark: SparkSession, impacts: Mapping[str, str] | None = None) -> DataFrame:
    """One row per rule-named segment: the rule in words, its steps in one text, the caller's impact or NULL."""
    plan = dimension(
        spark,
        Segment=list(RULED_STRATEGY),
        Characteristic=[text["rule"] for text in RULED_STRATEGY.values()],
        steps=[text["steps"] for text in RULED_STRATEGY.values()],
        impact=[(impacts or {}).get(name, "") for name in RULED_STRATEGY],
    )
    return plan.select(
        "Segment", "Characteristic", F.array_join("steps", "; ").alias("Strategy"), F.expr("nullif(impact, '')").alias("Expected_Impact")
    )
