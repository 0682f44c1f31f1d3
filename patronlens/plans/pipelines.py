"""The stages in order, in the three variants users run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from patronlens.operators.cleaning import clean_lines

from patronlens.operators.clustering import (
    K_RANGE, RESTARTS, Centers, best_k, business_k, by_mean_monetary, fit_kmeans, measure,
)
from patronlens.operators.distributions import quantile_thresholds
from patronlens.operators.features import Scaling, fit_robust, fit_standard
from patronlens.operators.rfm import build_rfm, invoice_totals, merged_totals, rfm_of_totals
from patronlens.operators.scoring import score_customers
from patronlens.operators.segments import cluster_means, name_segments, rank_names, rule_names
from patronlens.sources.csv_lines import read_lines_csv
from patronlens.sources.parts import SOURCE, Refreshed, refresh


@dataclass
class Segmentation:
    """Customers with Cluster and Segment_Name, and how the clusters came about."""

    customers: DataFrame
    scaling: Scaling
    centers: Centers
    sweep: DataFrame | None


def scored_customers(clean: DataFrame, snapshot: datetime | None = None, **scoring) -> DataFrame:
    return score_customers(build_rfm(clean, snapshot), **scoring)


def followed_rfm(
    spark: SparkSession, lines_path: str, path: str, *, snapshot: datetime | None = None, **reading
) -> tuple[DataFrame, Refreshed]:
    """The customer table of CSV parts that come and change, and what became of the parts.

    The table at ``path`` keeps totals per part, customer and invoice.  Parts that were added or
    changed are read and cleaned, the others are not opened; ``reading`` goes to the CSV reader.
    """

    def build(files: list[str]) -> DataFrame:
        lines = read_lines_csv(spark, files, source_column=SOURCE, **reading)
        return invoice_totals(clean_lines(lines), SOURCE)

    parts = refresh(spark, path, lines_path, build, settings={"version": 1, **reading})
    return rfm_of_totals(merged_totals(parts.rows), snapshot), parts


def segment_customers(
    scored: DataFrame,
    *,
    scaling: str = "robust",
    k: int | None = None,
    ks: Iterable[int] | None = None,
    choose: str = "business",
    naming: str = "rank",
    metric: str = "squared",
    restarts: int = RESTARTS,
    parallelism: int = 8,
) -> Segmentation:
    """Scale, sweep over k (or take the given one), assign and name.

    The sweep keeps its best fit per k, so the chosen k needs no further fit.  With a
    given ``k`` the sweep over ``ks`` is made beside it where ``ks`` is given too.
    ``metric`` says whether silhouettes take squared or plain distances.
    Cluster ids follow falling mean spend.  ``scored`` is read many times: hand in a
    stage table, or expressions over one as ``scored_customers`` returns them.
    """
    scaler = fit_robust(scored) if scaling == "robust" else fit_standard(scored)
    features = scaler.apply(scored)
    swept = list(ks) if ks is not None else [] if k else list(K_RANGE)
    fits = fit_kmeans(features, sorted({*swept, *([k] if k else [])}), restarts=restarts)
    sweep = measure(features, {n: fits[n] for n in swept}, metric=metric, parallelism=parallelism) if swept else None
    if k is None:
        chosen = business_k(sweep) if choose == "business" else best_k(sweep)
        k = chosen.first()["k"]
    centers = by_mean_monetary(features, fits[k])
    clustered = centers.assign(features)
    return Segmentation(with_segment_names(clustered, naming), scaler, centers, sweep)


def with_segment_names(clustered: DataFrame, naming: str) -> DataFrame:
    means = cluster_means(clustered)
    if naming == "rank":
        names = rank_names(means).withColumnRenamed("Segment", "Segment_Name")
    else:
        names = rule_names(means, quantile_thresholds(clustered))
    return name_segments(clustered, names)


# The three ways the pipeline is run: settings for segment_customers.
VARIANTS = {
    "cli": {"scaling": "robust", "choose": "business", "naming": "rank"},
    "notebook": {"scaling": "standard", "k": 5, "ks": K_RANGE, "naming": "rule"},
    "verify": {"scaling": "standard", "ks": range(2, 8), "choose": "best", "naming": "rank"},
}
