"""A local session for tests, benchmarks and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """On a cluster, bring your own session; nothing in the package changes its settings."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("patronlens")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
