"""Checks on the pipeline's tables, as rows (check, failed_rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronlens.operators.shaping import unpivot
from patronlens.schemas import RFM

_REPORT = ["check", "failed_rows"]


def _missing_columns(df: DataFrame, required: list[str]) -> int:
    return len([c for c in required if c not in df.columns])


def quality_checks(clean: DataFrame, scored: DataFrame, sweep: DataFrame | None = None) -> DataFrame:
    """Zero failed rows means the check holds.

    Each table is read once; asking whether any clean line exists stops at the first.
    """
    absent = F.lit(_missing_columns(clean, ["CustomerID", "TotalPrice"])).cast("long")
    no_measure = F.lit(_missing_columns(scored, RFM)).cast("long")
    lines = unpivot(
        clean.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("any_rows")),
        _REPORT,
        [
            (F.lit("line_columns_present"), absent),
            (F.lit("clean_lines_remain"), F.when(F.col("any_rows") > 0, 0).otherwise(1).cast("long")),
        ],
    )
    customers = unpivot(
        scored.agg(
            F.count_if(~F.coalesce(F.col("Monetary") > 0, F.lit(False))).alias("not_positive"),
            F.count_if(F.col("RFM_Score").isNull()).alias("no_score"),
        ),
        _REPORT,
        [
            (F.lit("rfm_columns_present"), no_measure),
            (F.lit("monetary_positive"), F.col("not_positive")),
            (F.lit("rfm_score_present"), F.col("no_score")),
        ],
    )
    checks = lines.unionByName(customers)
    if sweep is not None:
        best = unpivot(
            sweep.agg(F.max("silhouette").alias("best")),
            _REPORT,
            [(F.lit("best_silhouette_positive"), F.when(F.col("best") > 0, 0).otherwise(1).cast("long"))],
        )
        checks = checks.unionByName(best)
    return checks
