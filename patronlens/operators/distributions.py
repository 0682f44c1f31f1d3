"""How customers spread over levels, value ranges and the purchase funnel."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.functions.columns import half_even, share
from patronlens.functions.quantiles import exact_quantiles
from patronlens.operators.shaping import dimension, unpivot
from patronlens.schemas import LEVELS, RFM

QUARTILES = [0.25, 0.5, 0.75]
# Powers of the offsets that a cell of the density keeps.
_TERMS = 10

# The names of the funnel stages, widest first by convention.
FUNNEL_STAGES = ["All customers", "Active customers", "First purchase", "Repeat purchase", "High value"]


def level_counts(scored: DataFrame) -> DataFrame:
    """Customers per level from Champion down to Low; a level nobody has counts 0."""
    counts = scored.groupBy("Customer_Level").agg(F.count(F.lit(1)).alias("counted"))
    names = list(LEVELS)
    levels = dimension(scored.sparkSession, Customer_Level=names, level_order=list(range(len(names), 0, -1)))
    return (
        levels.join(counts, "Customer_Level", "left")
        .select("Customer_Level", "level_order", F.coalesce("counted", F.lit(0)).alias("customers"))
        .orderBy("level_order")
    )


def level_distribution(scored: DataFrame) -> DataFrame:
    """Customers per level, largest first; equal counts go from Low up."""
    return (
        level_counts(scored)
        .orderBy(F.desc("customers"), F.desc("level_order"))
        .select("Customer_Level", "customers")
    )


def level_shares(scored: DataFrame) -> DataFrame:
    counts = level_counts(scored)
    total = F.sum("customers").over(Window.partitionBy())
    return counts.withColumn("pct_customers", share(F.col("customers"), total)).orderBy("level_order")


def level_profile(scored: DataFrame) -> DataFrame:
    """Mean recency, frequency and monetary value per level; NULL for a level nobody has."""
    means = scored.groupBy("Customer_Level").agg(*[half_even(F.avg(c), 2).alias(c) for c in RFM])
    names = list(LEVELS)
    levels = dimension(scored.sparkSession, Customer_Level=names, level_order=list(range(len(names))))
    return (
        levels.join(means, "Customer_Level", "left").orderBy("level_order").select("Customer_Level", *RFM)
    )


def quantile_thresholds(rfm: DataFrame) -> dict[str, list[float]]:
    """Exact quartiles of the three measures."""
    return exact_quantiles(rfm, {c: QUARTILES for c in RFM})


def threshold_table(rfm: DataFrame) -> DataFrame:
    quartiles = quantile_thresholds(rfm)
    return dimension(
        rfm.sparkSession,
        measure=RFM,
        **{f"p{int(p * 100)}": [quartiles[c][i] for c in RFM] for i, p in enumerate(QUARTILES)},
    )


def funnel(rfm: DataFrame, active_days: int = 90) -> DataFrame:
    """Customer counts per stage.

    The stages are independent counts, not nested ones: the third holds everybody,
    and a later one may be larger than an earlier one.
    """
    high_value = exact_quantiles(rfm, {"Monetary": [0.75]})["Monetary"][0]
    conditions = [
        F.lit(True),
        F.col("Recency") < active_days,
        F.col("Frequency") >= 1,
        F.col("Frequency") >= 2,
        F.col("Monetary") > F.lit(high_value),
    ]
    row = rfm.agg(*[F.count_if(c).alias(f"stage_{i}") for i, c in enumerate(conditions)])
    return unpivot(
        row,
        ["stage_order", "stage", "customers"],
        [(F.lit(i + 1), F.lit(name), F.col(f"stage_{i}")) for i, name in enumerate(FUNNEL_STAGES)],
    )


@dataclass(frozen=True)
class _Extent:
    low: float
    high: float
    deviation: float | None
    rows: int

    def edge(self, number: int, steps: int) -> float:
        """The number-th of ``steps`` + 1 evenly spaced points from low to high."""
        return self.high if number == steps else number * ((self.high - self.low) / steps) + self.low


def _value(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _extents(df: DataFrame, columns: Sequence[str]) -> dict[str, _Extent]:
    """Range, deviation and count of each column that has values, in one aggregate; a zero range is widened by half on both sides."""
    row = df.agg(
        *[
            statistic(_value(c)).alias(f"{c}_{name}")
            for c in columns
            for name, statistic in (("low", F.min), ("high", F.max), ("deviation", F.stddev_samp), ("rows", F.count))
        ]
    ).first()
    extents = {}
    for c in columns:
        low, high, deviation, rows = (row[f"{c}_{name}"] for name in ("low", "high", "deviation", "rows"))
        if rows:
            widened = 0.5 if low == high else 0.0
            extents[c] = _Extent(low - widened, high + widened, deviation, rows)
    return extents


def _bin(value: Column, extent: _Extent, bins: int) -> Column:
    """The bin guessed by division, checked against its edges, so a value on an edge lands where a comparison puts it."""
    low, high = F.lit(extent.low), F.lit(extent.high)
    width = (high - low) / float(bins)
    guess = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")

    def edge(number: Column) -> Column:
        return F.when(number == bins, high).otherwise(number * width + low)

    return F.when(value < edge(guess), guess - 1).when((value >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)


def histogram(df: DataFrame, columns: Sequence[str] = tuple(RFM), bins: int = 50) -> DataFrame:
    """Equal-width bins per measure, empty ones included; the last bin is closed on the right.

    Two passes: one aggregate for the extents, and one that counts the bins of all measures on the map side.
    """
    extents = _extents(df, columns)
    entries = [
        F.when(_value(c).isNotNull(), F.struct(F.lit(c).alias("measure"), _bin(_value(c), e, bins).alias("bin")))
        for c, e in extents.items()
    ]
    listed = df.select(F.inline(F.array_compact(F.array(*entries)))) if entries else df.select(
        F.lit("").alias("measure"), F.lit(0).alias("bin")
    ).limit(0)
    counts = listed.groupBy("measure", "bin").agg(F.count(F.lit(1)).alias("counted"))
    grid = [(c, b, e.edge(b, bins), e.edge(b + 1, bins)) for c, e in extents.items() for b in range(bins)]
    table = df.sparkSession.createDataFrame(grid, "measure string, bin int, bin_start double, bin_end double")
    return table.join(counts, ["measure", "bin"], "left").select(
        "measure", "bin", "bin_start", "bin_end", F.coalesce("counted", F.lit(0)).alias("customers")
    )


def density_curve(
    df: DataFrame, columns: Sequence[str] = tuple(RFM), points: int = 200, bins: int = 50
) -> DataFrame:
    """Gaussian kernel density per measure on an even grid between its extremes.

    Bandwidth h is Scott's: sample deviation times rows ** -1/5.  ``count_scale`` is the height
    that matches a histogram of ``bins`` bins.  A measure with fewer than two different values has
    no density.

    Values are gathered in cells of width h / 4, each kept as the sums of the first ``_TERMS``
    powers of its values' offsets t from its middle, in bandwidths.  A kernel is
    ``exp(-s * s / 2) * sum(He_n(s) * t ** n / n!)`` with Hermite polynomials He_n and s the point's
    distance from the middle; as |He_n(s)| * exp(-s * s / 4) <= 1.0865 * sqrt(n!) and |t| <= 1/8, what
    the left-out terms add is below 1e-12 of a kernel's height for every value.  Cells farther than
    9 bandwidths from a point add less than 1e-17 and are not asked.  So the cost after the one
    map-side count depends on the range in bandwidths and on ``points``, not on the values.
    """
    extents = {c: e for c, e in _extents(df, columns).items() if e.deviation}
    if not extents:
        return df.sparkSession.createDataFrame([], "measure string, point int, x double, density double, count_scale double")
    widths = {c: e.deviation * float(e.rows) ** -0.2 for c, e in extents.items()}

    def entry(c: str, e: _Extent) -> Column:
        place = (_value(c) - F.lit(e.low)) / F.lit(widths[c])
        return F.when(_value(c).isNotNull(), F.struct(F.lit(c).alias("measure"), place.alias("place")))

    listed = df.select(F.inline(F.array_compact(F.array(*[entry(c, e) for c, e in extents.items()]))))
    cell = F.floor(F.col("place") * 4).alias("cell")
    offsets = listed.select("measure", cell, "place").withColumn("t", F.col("place") - (F.col("cell") + 0.5) / 4)
    powers = [F.count(F.lit(1)).cast("double"), *[F.sum(F.pow("t", F.lit(n))) for n in range(1, _TERMS)]]
    cells = offsets.groupBy("measure", "cell").agg(*[m.alias(f"moment_{n}") for n, m in enumerate(powers)])
    # Coefficients of the polynomial in s that a cell's kernels share.
    hermite = _hermite(_TERMS)
    coefficients = [
        reduce(add, [F.col(f"moment_{n}") * (hermite[n][j] / math.factorial(n)) for n in range(j, _TERMS) if hermite[n][j]])
        for j in range(_TERMS)
    ]
    spans = [(c, (e.high - e.low) / (points - 1) / widths[c]) for c, e in extents.items()]
    step = reduce(lambda otherwise, s: F.when(F.col("measure") == s[0], s[1]).otherwise(otherwise), spans, F.lit(None).cast("double"))
    middle = (F.col("cell") + 0.5) / 4
    reached = (
        cells.select("measure", middle.alias("middle"), step.alias("step"), *[k.alias(f"c_{j}") for j, k in enumerate(coefficients)])
        .withColumn("first", F.greatest(F.lit(0), F.ceil((F.col("middle") - 9.0) / F.col("step"))))
        .withColumn("last", F.least(F.lit(points - 1), F.floor((F.col("middle") + 9.0) / F.col("step"))))
        .where(F.col("first") <= F.col("last"))
        .withColumn("point", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))))
        .withColumn("s", F.col("point") * F.col("step") - F.col("middle"))
    )
    polynomial = reduce(lambda value, j: value * F.col("s") + F.col(f"c_{j}"), reversed(range(_TERMS - 1)), F.col(f"c_{_TERMS - 1}"))
    totals = reached.groupBy("measure", "point").agg(F.sum(F.exp(F.col("s") * F.col("s") * -0.5) * polynomial).alias("total"))
    facts = [
        (c, i, e.edge(i, points - 1), e.rows, (e.high - e.low) / bins, widths[c] * math.sqrt(2 * math.pi))
        for c, e in extents.items() for i in range(points)
    ]
    table = df.sparkSession.createDataFrame(facts, "measure string, point int, x double, rows long, width double, scale double")
    height = F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(0.0)) / F.col("scale")
    return table.join(totals, ["measure", "point"], "left").select(
        "measure", "point", "x", (height / F.col("rows")).alias("density"), (height * F.col("width")).alias("count_scale")
    )


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients, by rising power, of He_0 = 1, He_1 = s and He_(n+1) = s * He_n - n * He_(n-1)."""
    rows = [[1] + [0] * (terms - 1), [0, 1] + [0] * (terms - 2)]
    for n in range(1, terms - 1):
        rows.append([(rows[n][j - 1] if j else 0) - n * rows[n - 1][j] for j in range(terms)])
    return rows
