"""Scaled features for clustering: R, F and M columns beside the raw measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.functions.quantiles import exact_quantiles
from patronlens.operators.shaping import unpivot
from patronlens.schemas import RFM

FEATURES = ["R", "F", "M"]


@dataclass(frozen=True)
class Scaling:
    """(value - center) / scale per measure, after log1p where ``log`` is set."""

    center: Sequence[float]
    scale: Sequence[float]
    log: bool = False

    def column(self, position: int) -> Column:
        value = F.col(RFM[position]).cast("double")
        if self.log:
            value = F.log1p(value)
        return (value - F.lit(self.center[position])) / F.lit(self.scale[position])

    def apply(self, rfm: DataFrame) -> DataFrame:
        return rfm.withColumns({name: self.column(i) for i, name in enumerate(FEATURES)})


def log_measures(rfm: DataFrame) -> DataFrame:
    return rfm.withColumns({c: F.log1p(c) for c in RFM})


def fit_robust(rfm: DataFrame, *, log: bool = True) -> Scaling:
    """Median and interquartile range, exact; a zero range divides by 1.

    A measure of -1 or less has no logarithm: a snapshot before the last purchase gives such a Recency.
    """
    if log and not rfm.where(reduce(or_, [F.col(c) <= -1 for c in RFM])).isEmpty():
        raise ValueError("a measure is -1 or less; is the snapshot date before the last purchase?")
    quartiles = exact_quantiles(log_measures(rfm) if log else rfm, {c: [0.25, 0.5, 0.75] for c in RFM})
    return Scaling(
        center=[quartiles[c][1] for c in RFM],
        scale=[(quartiles[c][2] - quartiles[c][0]) or 1.0 for c in RFM],
        log=log,
    )


def fit_standard(rfm: DataFrame) -> Scaling:
    """Mean and population deviation; a zero deviation divides by 1."""
    row = rfm.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in RFM], *[F.stddev_pop(c).alias(f"deviation_{c}") for c in RFM]
    ).first()
    return Scaling(
        center=[row[f"mean_{c}"] for c in RFM], scale=[row[f"deviation_{c}"] or 1.0 for c in RFM]
    )


def scaling_check(features: DataFrame) -> DataFrame:
    """Mean and sample deviation of each scaled feature."""
    row = features.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"std_{c}") for c in FEATURES]
    )
    return unpivot(
        row,
        ["feature", "mean", "std"],
        [(F.lit(c), F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in FEATURES],
    )
