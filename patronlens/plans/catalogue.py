"""Ready-made queries over a folder of order tables, one per operator.

Every query reads its whole tables.  Those that need clusters without the chance in
k-means use the fixed centers below, so that SQL can check all that follows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronlens.functions.columns import wall_clock
from patronlens.operators import cleaning, distributions, profiling, reports, segments
from patronlens.operators.clustering import Centers, best_k, business_k, by_mean_monetary, fit_checks, fit_kmeans, measure
from patronlens.operators.features import FEATURES, fit_robust, fit_standard, log_measures, scaling_check
from patronlens.operators.projection import fit_components
from patronlens.operators.quality import quality_checks
from patronlens.operators.rfm import build_rfm, monthly_sketches, rfm_of_totals, totals_of_months
from patronlens.operators.scoring import frequency_cutoffs, frequency_score, score_customers
from patronlens.operators.silhouette import plain_silhouette, silhouette
from patronlens.plans import pipelines
from patronlens.plans.pipelines import VARIANTS, segment_customers
from patronlens.schemas import CLEAN_COLUMNS, CUSTOMER, LEGACY_NAMES, RFM, SCORES
from patronlens.sources import csv_lines, exports, stages
from patronlens.sources.tables import order_lines, purchases, table

Query = Callable[[SparkSession, str], DataFrame]

SALE_COLUMNS = ["InvoiceNo", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]

# Centers in the space of log-robust and of standard features.
ROBUST_CENTERS = Centers([(0.6, -0.8, -1.0), (-0.4, 0.5, 0.6), (-0.3, -0.5, -0.5), (0.3, 0.2, 0.2)])
STANDARD_CENTERS = Centers(
    [(-0.2, -0.2, -0.2), (-0.9, 0.9, 1.4), (2.0, 0.9, 1.6), (-0.9, -0.9, -0.9), (1.6, -0.9, -0.9)]
)
SNAPSHOT = datetime(2002, 1, 1, 12, 0, 0)


def diagonal_centers(k: int) -> Centers:
    """k centers evenly spaced from stale, rare and low to recent, frequent and high."""
    steps = [(2 * i + 1) / k - 1 for i in range(k)]
    return Centers([(-t, t, t) for t in steps])


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return order_lines(spark, folder)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_lines(order_lines(spark, folder))


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    """Clean lines with only the columns the customer table needs."""
    return cleaning.clean_lines(order_lines(spark, folder, SALE_COLUMNS))


def _rfm(spark: SparkSession, folder: str) -> DataFrame:
    return build_rfm(_sales(spark, folder))


def _scored(spark: SparkSession, folder: str, **options) -> DataFrame:
    return score_customers(_rfm(spark, folder), **options)


def _robust(spark: SparkSession, folder: str) -> DataFrame:
    rfm = _rfm(spark, folder)
    return fit_robust(rfm).apply(rfm)


def _standard(spark: SparkSession, folder: str) -> DataFrame:
    rfm = _rfm(spark, folder)
    return fit_standard(rfm).apply(rfm)


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    return ROBUST_CENTERS.assign(_robust(spark, folder))


def _ruled(spark: SparkSession, folder: str) -> DataFrame:
    clustered = STANDARD_CENTERS.assign(_standard(spark, folder))
    quartiles = distributions.quantile_thresholds(clustered)
    return segments.name_segments(clustered, segments.rule_names(segments.cluster_means(clustered), quartiles))


def _sweep(spark: SparkSession, folder: str) -> DataFrame:
    return measure(_robust(spark, folder), {k: diagonal_centers(k) for k in range(2, 11)})


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _money(df: DataFrame) -> DataFrame:
    return _rounded(df, Monetary=2)


def _features(df: DataFrame) -> DataFrame:
    return _rounded(df.select(CUSTOMER, *FEATURES), **dict.fromkeys(FEATURES, 6))


# -- sources and sinks ---------------------------------------------------------


def csv_chunks_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """Export all lines as CSV chunks, read them back and clean them."""
    path = stages.new_stage_path(spark, "line-chunks")
    lines = order_lines(spark, folder).withColumns(
        {"Quantity": F.col("Quantity").cast("long"), "CustomerID": F.col("CustomerID").cast("double")}
    )
    exports.write_csv_chunks(lines, path, chunk_bytes=1024 * 1024)
    clean = cleaning.clean_lines(csv_lines.read_lines_csv(spark, path))
    by_country = clean.groupBy("Country").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("TotalPrice").alias("revenue"),
        F.min("InvoiceDate").alias("first_date"),
        F.max(F.length("Description")).cast("long").alias("longest_description"),
    )
    return _rounded(by_country, revenue=2)


def ordered_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in chunks by date and invoice, read back: all there, none out of order, no file over the bound."""
    path, order, bound = stages.new_stage_path(spark, "ordered-chunks"), ["InvoiceDate", "InvoiceNo"], 256 * 1024
    lines = order_lines(spark, folder).withColumns(
        {"Quantity": F.col("Quantity").cast("long"), "CustomerID": F.col("CustomerID").cast("double")}
    )
    exports.write_ordered_chunks(lines, path, order, chunk_bytes=bound)
    key = F.struct("InvoiceDate", "InvoiceNo")
    back = csv_lines.read_lines_csv(spark, path, source_column="file")
    number = F.regexp_extract("file", r"chunk=(\d+)", 1).cast("long").alias("chunk")
    chunks = back.groupBy(number).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    chunks = stages.stage(chunks, "chunks")
    before = chunks.select((F.col("chunk") + 1).alias("chunk"), F.col("last").alias("earlier"))
    early = F.count_if(F.col("first") < F.col("earlier")).alias("out_of_order")
    sums = chunks.join(before, "chunk", "left").agg(F.sum("rows").alias("lines"), early, F.lit(0).alias("over_bound"))
    sizes = spark.read.format("binaryFile").load(f"{path}/chunk=*").select(F.col("_metadata.file_size").alias("bytes"))
    sizes = sizes.agg(F.lit(0).alias("lines"), F.lit(0).alias("out_of_order"), F.count_if(F.col("bytes") > bound).alias("over_bound"))
    return sums.unionByName(sizes).agg(*[F.sum(c).alias(c) for c in sums.columns])


def followed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table of three CSV parts, of which one is written anew and one added after the first reading."""
    lines, path = order_lines(spark, folder), stages.new_stage_path(spark, "followed")
    lines = lines.withColumns({"Quantity": F.col("Quantity").cast("long"), "CustomerID": F.col("CustomerID").cast("double")})
    part = F.pmod(F.crc32("InvoiceNo"), F.lit(3))
    half = F.pmod(F.crc32("StockCode"), F.lit(2)) == 0

    def write(number: int, rows: DataFrame) -> None:
        exports.write_csv_chunks(rows, f"{path}/lines/part{number}", chunk_bytes=1 << 30)

    write(0, lines.where(part == 0))
    write(1, lines.where((part == 1) & half))
    pipelines.followed_rfm(spark, f"{path}/lines/*", f"{path}/totals")
    write(1, lines.where(part == 1))
    write(2, lines.where(part == 2))
    rfm, _ = pipelines.followed_rfm(spark, f"{path}/lines/*", f"{path}/totals")
    return _money(rfm)


def stage_monthly_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Build the clean table, then take it from its stage and report on it."""
    path = stages.new_stage_path(spark, "clean-lines")
    stages.read_or_build(spark, path, lambda: _sales(spark, folder))
    again = stages.read_or_build(spark, path, lambda: _sales(spark, folder))
    return _rounded(profiling.monthly_revenue(again), revenue=2)


def union_yearly_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Two sources with the older column names, stacked and renamed."""
    older = {new: old for old, new in LEGACY_NAMES.items()}
    lines = order_lines(spark, folder, SALE_COLUMNS).withColumnsRenamed(older)
    cut = wall_clock(datetime(1998, 1, 1))
    both = csv_lines.union_sources(
        [lines.where(F.col("InvoiceDate") < cut), lines.where((F.col("InvoiceDate") >= cut) | F.col("InvoiceDate").isNull())]
    )
    by_year = both.groupBy(F.year("InvoiceDate").alias("year")).agg(
        F.count("InvoiceNo").alias("lines"), F.sum(F.col("Quantity") * F.col("UnitPrice")).alias("amount")
    )
    return _rounded(by_year, amount=2)


def strategy_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The strategy report written as CSV with a byte order mark, and read back."""
    path = stages.new_stage_path(spark, "strategy-report")
    report = reports.strategy_report(_clustered(spark, folder))
    exports.write_report_csv(report.select("Cluster", "Segment", "Customers", "Strategy"), path)
    return spark.read.schema("Cluster int, Segment string, Customers bigint, Strategy string").option(
        "header", True
    ).option("enforceSchema", True).csv(path)


# -- cleaning and profiling ----------------------------------------------------


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder).select(*CLEAN_COLUMNS)


def clean_audit(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.cleaning_audit(order_lines(spark, folder, SALE_COLUMNS))


def head_preview(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.preview(_clean(spark, folder).select(*CLEAN_COLUMNS), CLEAN_COLUMNS, 10)


def shape_and_range(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.shape_and_range(_lines(spark, folder))


def schema_listing(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.schema_listing(_lines(spark, folder))


def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.missing_counts(_lines(spark, folder))


def describe_lines(spark: SparkSession, folder: str) -> DataFrame:
    numbers = order_lines(spark, folder, ["Quantity", "UnitPrice", "CustomerID"])
    described = profiling.describe(numbers, numbers.columns)
    return _rounded(described, mean=4, std=4, q25=4, q50=4, q75=4)


def describe_rfm(spark: SparkSession, folder: str) -> DataFrame:
    described = profiling.describe(_rfm(spark, folder), RFM)
    return _rounded(described, mean=4, std=4, min=4, q25=4, q50=4, q75=4, max=4)


def kpis(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profiling.business_summary(_sales(spark, folder)), revenue=2)


def top_countries(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.top_countries(_clean(spark, folder))


def monthly_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profiling.monthly_revenue(_sales(spark, folder)), revenue=2)


# -- customer table and scores -------------------------------------------------


def snapshot_date(spark: SparkSession, folder: str) -> DataFrame:
    last = F.max("InvoiceDate")
    return _sales(spark, folder).agg(last.alias("last_purchase"), (last + F.expr("INTERVAL 1 DAY")).alias("snapshot"))


def rfm_table(spark: SparkSession, folder: str) -> DataFrame:
    return _money(_rfm(spark, folder))


def rfm_given_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _money(build_rfm(_sales(spark, folder), SNAPSHOT))


def rfm_by_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices counted by monthly sketches; so small counts are exact."""
    months = stages.stage(monthly_sketches(_sales(spark, folder)), "monthly-sketches")
    return _money(rfm_of_totals(totals_of_months(months)))


def rfm_events(spark: SparkSession, folder: str) -> DataFrame:
    return _money(build_rfm(purchases(spark, folder)))


def rfm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _money(_scored(spark, folder))


def rfm_scores_recent_high(spark: SparkSession, folder: str) -> DataFrame:
    return _money(_scored(spark, folder, recency_order="descending"))


def rfm_scores_labelled(spark: SparkSession, folder: str) -> DataFrame:
    return _money(_scored(spark, folder, labels=["E", "D", "C", "B", "A"]))


def rfm_scores_events(spark: SparkSession, folder: str) -> DataFrame:
    """Recency edges coincide on these data."""
    return _money(score_customers(build_rfm(purchases(spark, folder)), duplicates="drop"))


def frequency_scores(spark: SparkSession, folder: str) -> DataFrame:
    rfm = _rfm(spark, folder)
    return rfm.select(CUSTOMER, "Frequency", frequency_score(frequency_cutoffs(rfm)).alias("F_Score"))


def level_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.level_distribution(_scored(spark, folder))


def level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.level_counts(_scored(spark, folder))


def level_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(distributions.level_shares(_scored(spark, folder)), pct_customers=4)


def level_profile(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.level_profile(_scored(spark, folder))


def quantile_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(distributions.threshold_table(_rfm(spark, folder)), p25=4, p50=4, p75=4)


def funnel(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.funnel(_rfm(spark, folder))


def rfm_histograms(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(distributions.histogram(_rfm(spark, folder)), bin_start=4, bin_end=4)


def rfm_density(spark: SparkSession, folder: str) -> DataFrame:
    curve = distributions.density_curve(_rfm(spark, folder))
    return curve.select(
        "measure",
        "point",
        F.round("x", 4).alias("x"),
        F.round(F.col("density") * 1e9, 2).alias("density_e9"),
        F.round("count_scale", 4).alias("count_scale"),
    )


# -- features and clusters -----------------------------------------------------


def log_features(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(log_measures(_rfm(spark, folder)), **dict.fromkeys(RFM, 6))


def robust_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features(_robust(spark, folder))


def standard_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features(_standard(spark, folder))


def standard_check(spark: SparkSession, folder: str) -> DataFrame:
    check = scaling_check(_standard(spark, folder))
    # Adding zero turns a rounded -0.0 into 0.0.
    return check.select("feature", (F.round("mean", 6) + 0.0).alias("mean"), F.round("std", 6).alias("std"))


def fixed_center_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return _clustered(spark, folder).select(CUSTOMER, "Cluster")


def fixed_center_inertia(spark: SparkSession, folder: str) -> DataFrame:
    clustered = ROBUST_CENTERS.assign(_robust(spark, folder), cost="cost")
    return clustered.agg(F.round(F.sum("cost"), 4).alias("inertia"))


def silhouette_squared(spark: SparkSession, folder: str) -> DataFrame:
    score = silhouette(_clustered(spark, folder))
    return spark.createDataFrame([(ROBUST_CENTERS.k, round(score, 6))], "k int, silhouette double")


def silhouette_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Two digits of the interval's middle, for it is not the exact score."""
    score = plain_silhouette(stages.stage(_clustered(spark, folder), "clustered"))
    return spark.createDataFrame([(ROBUST_CENTERS.k, round(score.score, 2))], "k int, silhouette double")


def plain_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The k that plain distances choose, by both rules."""
    features = stages.stage(_robust(spark, folder), "features")
    sweep = measure(features, {k: diagonal_centers(k) for k in range(2, 11)}, metric="plain")
    return best_k(sweep).select(F.col("k").alias("best_k"), business_k(sweep).select("k").scalar().alias("business_k"))


def k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_sweep(spark, folder), inertia=4, silhouette=6)


def sweep_best_k(spark: SparkSession, folder: str) -> DataFrame:
    return best_k(_sweep(spark, folder)).select("k")


def sweep_business_k(spark: SparkSession, folder: str) -> DataFrame:
    return business_k(_sweep(spark, folder)).select("k")


def canonical_clusters(spark: SparkSession, folder: str) -> DataFrame:
    features = _robust(spark, folder)
    return by_mean_monetary(features, ROBUST_CENTERS).assign(features).select(CUSTOMER, "Cluster")


def pca_projection(spark: SparkSession, folder: str) -> DataFrame:
    features = _standard(spark, folder)
    return _rounded(
        fit_components(features).project(features).select(CUSTOMER, "PC1", "PC2"), PC1=4, PC2=4
    )


def pca_variance(spark: SparkSession, folder: str) -> DataFrame:
    ratios = fit_components(_standard(spark, folder)).variance_ratio
    rows = [(i + 1, round(v, 6)) for i, v in enumerate(ratios)]
    return spark.createDataFrame(rows, "component int, variance_ratio double")


# -- segment reports -----------------------------------------------------------


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return reports.cluster_sizes(_clustered(spark, folder))


def cluster_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.cluster_shares(_clustered(spark, folder)), pct_customers=4)


def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reports.cluster_profile(_clustered(spark, folder))


def cluster_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.cluster_revenue(_clustered(spark, folder)), Revenue=2, Pct=4)


def ranked_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.rank_names(segments.cluster_means(_clustered(spark, folder)))


def rule_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _ruled(spark, folder).select(CUSTOMER, "Cluster", "Segment_Name")


def segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.segment_summary(_ruled(spark, folder))


def radar_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return reports.radar_profile(_clustered(spark, folder), "Cluster")


def radar_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    return reports.radar_profile(_ruled(spark, folder), "Segment_Name", recency_scale="one_to_five")


def strategy_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.strategy_report(_clustered(spark, folder))


def strategy_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The strategy matrix beside the number of customers it is meant for."""
    sizes = _ruled(spark, folder).groupBy(F.col("Segment_Name").alias("Segment")).agg(
        F.count(F.lit(1)).alias("counted")
    )
    return (
        segments.strategy_matrix(spark)
        .join(sizes, "Segment", "left")
        .withColumn("customers", F.coalesce("counted", F.lit(0)))
        .drop("counted")
    )


def scatter_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _money(reports.scatter_points(_ruled(spark, folder)))


def scatter_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _money(reports.scatter_sample(_ruled(spark, folder)))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    clean = _sales(spark, folder)
    rfm = build_rfm(clean)
    features = fit_robust(rfm).apply(rfm)
    return quality_checks(clean, score_customers(rfm), measure(features, {2: diagonal_centers(2)}))


# -- k-means: no SQL counterpart -----------------------------------------------


def _summary_of(variant: str, **settings) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = segment_customers(_scored(spark, folder), **{**VARIANTS[variant], **settings})
        return reports.segment_summary(result.customers)

    return run


def kmeans_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in four k-means clusters of the log-robust features."""
    result = segment_customers(_scored(spark, folder), **{**VARIANTS["cli"], "k": 4})
    return result.customers.select(CUSTOMER, *RFM, *SCORES, "RFM_Score", "Customer_Level", "Cluster", "Segment_Name")


def kmeans_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return segment_customers(_scored(spark, folder), **VARIANTS["cli"]).sweep


def _fit_checks(features: DataFrame, ks: range | list[int]) -> DataFrame:
    # Fits that ran to their fixed point, so that centers are means.
    fits = fit_kmeans(features, ks, relative_tol=0.0)
    return fit_checks(features, fits, {k: diagonal_centers(k) for k in ks})


def kmeans_checks_cli(spark: SparkSession, folder: str) -> DataFrame:
    return _fit_checks(_robust(spark, folder), range(2, 11))


def kmeans_checks_notebook(spark: SparkSession, folder: str) -> DataFrame:
    return _fit_checks(_standard(spark, folder), range(2, 11))


def kmeans_checks_verify(spark: SparkSession, folder: str) -> DataFrame:
    return _fit_checks(_standard(spark, folder), range(2, 8))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        csv_chunks_by_country, ordered_chunks, followed_parts, stage_monthly_revenue, union_yearly_sources, strategy_csv,
        clean_lines, clean_audit, head_preview, shape_and_range, schema_listing, null_counts,
        describe_lines, describe_rfm, kpis, top_countries, monthly_revenue,
        snapshot_date, rfm_table, rfm_given_snapshot, rfm_by_sketches, rfm_events, rfm_scores,
        rfm_scores_recent_high, rfm_scores_labelled, rfm_scores_events, frequency_scores,
        level_distribution, level_counts, level_shares, level_profile, quantile_thresholds,
        funnel, rfm_histograms, rfm_density,
        log_features, robust_features, standard_features, standard_check,
        fixed_center_assignment, fixed_center_inertia, silhouette_squared, silhouette_plain, k_sweep, plain_sweep,
        sweep_best_k, sweep_business_k, canonical_clusters, pca_projection, pca_variance,
        cluster_sizes, cluster_shares, cluster_profile, cluster_revenue, ranked_segments,
        rule_segments, segment_summary, radar_by_cluster, radar_by_segment, strategy_report,
        strategy_matrix, scatter_extract, scatter_sample, quality, kmeans_segments, kmeans_sweep,
        kmeans_checks_cli, kmeans_checks_notebook, kmeans_checks_verify,
    ]
}
QUERIES["notebook_segments"] = _summary_of("notebook", ks=None)
QUERIES["verify_segments"] = _summary_of("verify")
