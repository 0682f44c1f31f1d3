"""Run the whole pipeline: line files in, stage tables and reports out.

    python -m patronlens --lines 'data/lines_part*.csv' --output out --variant cli

Exit codes: 0 all well, 1 no line files or an option that does not fit the data, 2 a quality check failed.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronlens.operators import distributions, profiling, reports, segments
from patronlens.operators.cleaning import clean_lines, cleaning_audit
from patronlens.operators.features import FEATURES, fit_standard
from patronlens.operators.projection import fit_components
from patronlens.operators.quality import quality_checks
from patronlens.plans.pipelines import VARIANTS, scored_customers, segment_customers
from patronlens.schemas import RFM
from patronlens.sources.csv_lines import malformed_fields, read_lines_csv
from patronlens.sources.exports import write_report_csv
from patronlens.sources.stages import read_or_build, stage, write_stage


def run(
    spark: SparkSession,
    lines_path: str,
    output: str,
    variant: str,
    *,
    rebuild: bool = False,
    snapshot: datetime | None = None,
    reading: dict | None = None,
    scoring: dict | None = None,
    **settings,
) -> bool:
    """Write clean, scored and clustered tables and every report below ``output``; whether all checks hold.

    ``reading`` goes to the CSV reader, ``scoring`` to the scores, ``settings`` to the
    segmentation.  Reports on raw lines are written whenever the clean table is built.
    """
    reading = reading or {}

    def write(tables: dict[str, DataFrame]) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{output}/reports/{name}")

    def build() -> DataFrame:
        # One reading of the CSV parts serves the reports and the clean table.
        raw = stage(read_lines_csv(spark, lines_path, **reading), "raw-lines")
        numbers = ["Quantity", "UnitPrice", "CustomerID"]
        write(
            {
                "cleaning_audit": cleaning_audit(raw),
                "shape_and_range": profiling.shape_and_range(raw),
                "schema_listing": profiling.schema_listing(raw),
                "missing_counts": profiling.missing_counts(raw),
                "line_description": profiling.describe(raw, numbers),
            }
        )
        if reading.get("malformed") == "null":
            options = {k: v for k, v in reading.items() if k != "malformed"}
            write({"malformed_fields": malformed_fields(spark, lines_path, **options)})
        return clean_lines(raw)

    clean = read_or_build(spark, f"{output}/clean_lines", build, rebuild=rebuild)
    scored = write_stage(scored_customers(clean, snapshot, **(scoring or {})), f"{output}/scored_customers")
    result = segment_customers(scored, **{**VARIANTS[variant], **settings})
    customers = write_stage(result.customers.drop(*FEATURES), f"{output}/clustered_customers")
    standard = fit_standard(customers).apply(customers)
    components = fit_components(standard)
    checks = stage(quality_checks(clean, scored, result.sweep), "quality-checks")

    tables = {
        "business_summary": profiling.business_summary(clean),
        "top_countries": profiling.top_countries(clean),
        "monthly_revenue": profiling.monthly_revenue(clean),
        "customer_description": profiling.describe(scored, RFM),
        "level_distribution": distributions.level_distribution(scored),
        "level_counts": distributions.level_counts(scored),
        "level_shares": distributions.level_shares(scored),
        "level_profile": distributions.level_profile(scored),
        "quantile_thresholds": distributions.threshold_table(scored),
        "funnel": distributions.funnel(customers),
        "histograms": distributions.histogram(customers),
        "density": distributions.density_curve(customers),
        "cluster_sizes": reports.cluster_sizes(customers),
        "cluster_shares": reports.cluster_shares(customers),
        "cluster_profile": reports.cluster_profile(customers),
        "cluster_revenue": reports.cluster_revenue(customers),
        "segment_summary": reports.segment_summary(customers),
        "radar": reports.radar_profile(customers, "Cluster"),
        "scatter_points": reports.scatter_points(customers),
        "principal_components": components.project(standard).select("CustomerID", "PC1", "PC2"),
        "component_variance": spark.createDataFrame(
            [(i, float(v)) for i, v in enumerate(components.variance_ratio, 1)], "component int, variance_ratio double"
        ),
        "quality_checks": checks,
    }
    if result.sweep is not None:
        tables["k_sweep"] = result.sweep
    write(tables)
    if VARIANTS[variant]["naming"] == "rank":
        write_report_csv(reports.strategy_report(customers), f"{output}/cluster_strategy")
    else:
        write_report_csv(segments.strategy_matrix(spark), f"{output}/segment_strategy")
    return checks.where(F.col("failed_rows") > 0).isEmpty()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="patronlens", description=__doc__)
    parser.add_argument("--lines", required=True, help="CSV files of retail lines; may hold globs")
    parser.add_argument("--output", required=True, help="folder for stage tables and reports")
    parser.add_argument("--variant", choices=list(VARIANTS), default="cli")
    parser.add_argument("--k", type=int, help="number of clusters instead of the variant's own choice")
    parser.add_argument("--silhouette", choices=["squared", "plain"], default="squared", help="distances of the sweep's silhouettes")
    parser.add_argument("--restarts", type=int, default=10, help="k-means fits per k")
    parser.add_argument("--rebuild", action="store_true", help="clean the lines again even if a clean table exists")
    parser.add_argument("--snapshot", type=datetime.fromisoformat, help="date that recency counts from")
    parser.add_argument("--recency-order", choices=["ascending", "descending"], default="ascending")
    parser.add_argument("--duplicates", choices=["raise", "drop"], default="raise", help="what coinciding quantile edges do")
    parser.add_argument("--multi-line", action="store_true", help="descriptions hold line breaks")
    parser.add_argument("--timestamp-format", help="form of InvoiceDate, if it is not yyyy-MM-dd HH:mm:ss")
    parser.add_argument("--malformed", choices=["raise", "null"], default="raise", help="what unreadable fields do")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("patronlens").getOrCreate()
    settings = {"restarts": options.restarts, "metric": options.silhouette} | ({"k": options.k} if options.k else {})
    try:
        good = run(
            spark, options.lines, options.output, options.variant, rebuild=options.rebuild, snapshot=options.snapshot,
            reading={"multi_line": options.multi_line, "timestamp_format": options.timestamp_format, "malformed": options.malformed},
            scoring={"recency_order": options.recency_order, "duplicates": options.duplicates},
            **settings,
        )
    except (FileNotFoundError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    if not good:
        print(f"a quality check failed; see {options.output}/reports/quality_checks", file=sys.stderr)
    return 0 if good else 2


if __name__ == "__main__":
    sys.exit(main())
