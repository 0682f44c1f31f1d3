"""Quintile scores and customer levels.

Recency and monetary scores cut at exact interpolated quantiles, so equal values
always score the same.  The frequency score cuts the ranks by (Frequency,
CustomerID), so equal frequencies are split evenly.  Neither uses ``ntile`` nor a
global window: a score compares a row with four known cut points.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.functions.quantiles import Target, exact_quantiles, order_statistics
from patronlens.schemas import CUSTOMER, LEVELS, RFM, SCORES

BINS = 5


def score_customers(
    rfm: DataFrame,
    *,
    labels: Sequence | None = None,
    recency_order: str = "ascending",
    duplicates: str = "raise",
) -> DataFrame:
    """Adds R_Score, F_Score, M_Score, their text RFM_Score and Customer_Level.

    ``recency_order="ascending"`` gives the **stalest** customers the highest
    recency score; ``"descending"`` gives it to the most recent ones.
    ``duplicates`` says what happens when quantile edges coincide: ``"raise"``, or
    ``"drop"`` to use the distinct edges and number the fewer bins from 1.
    With ``labels`` (five of them) the score columns hold labels; levels still
    follow the numbers.
    """
    if labels is not None and len(labels) != BINS:
        raise ValueError(f"labels must name {BINS} bins, got {len(labels)}")
    if recency_order not in ("ascending", "descending") or duplicates not in ("raise", "drop"):
        raise ValueError(f"unknown option: {recency_order!r} / {duplicates!r}")
    # Two independent sets of small jobs: submitted side by side.
    together = inheritable_thread_target(rfm.sparkSession)
    with ThreadPoolExecutor(2) as pool:
        cutting = pool.submit(together(quintile_edges), rfm, ["Recency", "Monetary"], duplicates)
        ranking = pool.submit(together(frequency_cutoffs), rfm)
        edges, cutoffs = cutting.result(), ranking.result()
    numbers = {
        "R_Score": bin_of("Recency", edges["Recency"], descending=recency_order == "descending"),
        "F_Score": frequency_score(cutoffs),
        "M_Score": bin_of("Monetary", edges["Monetary"]),
    }
    scored = rfm.withColumns(numbers)
    level = level_of(reduce(add, [F.col(s) for s in SCORES]))
    if labels is not None:
        names = F.array(*[F.lit(label) for label in labels])
        scored = scored.withColumn("Customer_Level", level).withColumns(
            {s: F.element_at(names, F.col(s)) for s in SCORES}
        )
    else:
        scored = scored.withColumn("Customer_Level", level)
    text = F.concat(*[F.col(s).cast("string") for s in SCORES])
    return scored.withColumn("RFM_Score", text).select(
        CUSTOMER, *RFM, *SCORES, "RFM_Score", "Customer_Level"
    )


def quintile_edges(
    rfm: DataFrame,
    columns: Sequence[str],
    duplicates: str = "raise",
) -> dict[str, list[float]]:
    """Outer and inner quintile edges per column, ascending and distinct."""
    steps = [i / BINS for i in range(BINS + 1)]
    edges = exact_quantiles(rfm, {c: steps for c in columns})
    for column, values in edges.items():
        if None in values:
            raise ValueError(f"{column} has no values to cut")
        distinct = sorted(set(values))
        if len(distinct) < len(values) and duplicates == "raise":
            raise ValueError(f"{column} has coinciding quantile edges {values}; pass duplicates='drop'")
        if len(distinct) < 2:
            raise ValueError(f"{column} has a single value, which cannot be cut")
        edges[column] = distinct
    return edges


def bin_of(column: str, edges: Sequence[float], *, descending: bool = False) -> Column:
    """1 + the number of inner edges strictly below the value: bins closed on the right."""
    inner = edges[1:-1]
    above = [(F.col(column) > F.lit(e)).cast("int") for e in inner]
    number = reduce(add, above, F.lit(1))
    return F.lit(len(inner) + 2) - number if descending else number


def frequency_cutoffs(rfm: DataFrame) -> list[tuple[int, int]]:
    """The (Frequency, CustomerID) pair that ends each of the first four fifths.

    Ranks run over (Frequency, CustomerID).  A histogram of frequencies tells which
    frequency a rank falls in and how far into it; the customer there is an order
    statistic of the ids with that frequency.  The histogram stays small: d
    different frequencies need at least d * (d + 1) / 2 invoices.
    """
    histogram = rfm.groupBy("Frequency").agg(F.count(F.lit(1)).alias("customers"))
    running = Window.orderBy("Frequency").rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.partitionBy()
    placed = histogram.select(
        "Frequency",
        "customers",
        (F.sum("customers").over(running) - F.col("customers")).alias("before"),
        F.sum("customers").over(everyone).alias("total"),
    )
    # 0-based rank of the last row of each fifth.
    ranks = F.array(*[F.expr(f"(total - 1) * {i} div {BINS}") for i in range(1, BINS)])
    hit = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("customers")))
    rows = (
        placed.select("*", F.explode(hit).alias("rank")).orderBy("rank").collect()
    )
    if not rows or rows[0]["total"] < 2:
        raise ValueError("frequency ranks need at least two customers")
    inside = {}
    for r in rows:
        inside.setdefault(r["Frequency"], []).append(r["rank"] - r["before"])
    targets = [Target(F.col("Frequency") == F.lit(f), ranks) for f, ranks in inside.items()]
    ids = order_statistics(rfm.select("Frequency", CUSTOMER), CUSTOMER, targets)
    return [(f, at[rank]) for (f, ranks), at in zip(inside.items(), ids) for rank in ranks]


def frequency_score(cutoffs: Sequence[tuple[int, int]]) -> Column:
    frequency, customer = F.col("Frequency"), F.col(CUSTOMER)
    past = [
        ((frequency > F.lit(f)) | ((frequency == F.lit(f)) & (customer > F.lit(c)))).cast("int")
        for f, c in cutoffs
    ]
    return reduce(add, past, F.lit(1))


def level_of(total: Column) -> Column:
    """Level for a sum of three scores; sums outside (0, 15] have none."""
    level = F.when(total <= 0, F.lit(None))
    for name, highest in LEVELS.items():
        level = level.when(total <= highest, F.lit(name))
    return level
