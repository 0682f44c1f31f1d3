from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from oracle import TESTDATA
from patronlens.__main__ import main
from patronlens.sources.exports import write_csv_chunks
from patronlens.sources.tables import order_lines


@pytest.fixture(scope="module")
def line_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "csv")
    lines = order_lines(spark, str(TESTDATA / "sf0.001")).withColumns(
        {"Quantity": F.col("Quantity").cast("long"), "CustomerID": F.col("CustomerID").cast("double")}
    )
    write_csv_chunks(lines, path, chunk_bytes=200_000)
    return path


RAW_REPORTS = {"cleaning_audit", "shape_and_range", "schema_listing", "missing_counts", "line_description"}
REPORTS = {
    "business_summary", "top_countries", "monthly_revenue", "customer_description", "level_distribution", "level_counts",
    "level_shares", "level_profile", "quantile_thresholds", "funnel", "histograms", "density", "cluster_sizes",
    "cluster_shares", "cluster_profile", "cluster_revenue", "segment_summary", "radar", "scatter_points",
    "principal_components", "component_variance", "quality_checks", "k_sweep",
}


@pytest.mark.parametrize(
    "variant, strategy, ks",
    [("cli", "cluster_strategy", 9), ("notebook", "segment_strategy", 9), ("verify", "cluster_strategy", 6)],
)
def test_csv_to_reports(spark, line_files, tmp_path, variant, strategy, ks):
    arguments = ["--lines", line_files, "--output", str(tmp_path), "--variant", variant, "--restarts", "1"]
    # The first build tells what cleaning removed, without --rebuild.
    assert main(arguments) == 0
    found = {p.name for p in (tmp_path / "reports").iterdir()}
    assert found == RAW_REPORTS | REPORTS
    for name in found:
        assert not spark.read.parquet(str(tmp_path / "reports" / name)).isEmpty(), name
    assert spark.read.parquet(str(tmp_path / "reports" / "k_sweep")).count() == ks
    customers = spark.read.parquet(str(tmp_path / "clustered_customers"))
    assert customers.count() == 150
    assert {"RFM_Score", "Customer_Level", "Cluster", "Segment_Name"} <= set(customers.columns)
    levels = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "reports" / "level_distribution")).collect()}
    assert levels == {"Low": 18, "Mid": 75, "High": 44, "Champion": 13}
    (file,) = (tmp_path / strategy).glob("*.csv")
    with open(file, encoding="utf-8-sig", newline="") as handle:
        rows = list(csv.DictReader(handle))
    assert rows and all(r["Strategy"] for r in rows)


def test_options_reach_the_stages(spark, line_files, tmp_path, capsys):
    arguments = ["--lines", line_files, "--output", str(tmp_path), "--restarts", "1", "--k", "3"]
    assert main([*arguments, "--recency-order", "descending", "--snapshot", "2030-01-01"]) == 0
    scored = spark.read.parquet(str(tmp_path / "scored_customers"))
    assert scored.agg(F.min("Recency")).first()[0] > 5000
    assert spark.read.parquet(str(tmp_path / "clustered_customers")).select("Cluster").distinct().count() == 3
    assert main([*arguments, "--snapshot", "1990-01-01"]) == 1
    assert "snapshot" in capsys.readouterr().err


def test_a_failed_check_is_told(line_files, tmp_path, monkeypatch):
    import patronlens.__main__ as command

    broken = lambda clean, scored, sweep: clean.sparkSession.createDataFrame([("x", 1)], "check string, failed_rows long")
    monkeypatch.setattr(command, "quality_checks", broken)
    assert main(["--lines", line_files, "--output", str(tmp_path), "--restarts", "1", "--k", "2"]) == 2


def test_missing_lines_exit_with_one(spark, tmp_path):
    assert main(["--lines", str(tmp_path / "none*.csv"), "--output", str(tmp_path / "out")]) == 1
