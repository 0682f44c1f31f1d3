from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("patronlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_rfm(spark):
    """A customer table from (id, recency, frequency, monetary) tuples."""

    def make(rows):
        return spark.createDataFrame(rows, "CustomerID bigint, Recency bigint, Frequency bigint, Monetary double")

    return make


@pytest.fixture
def make_lines(spark):
    """Raw lines from dicts; what is not given takes an ordinary value."""
    from datetime import datetime

    from patronlens.schemas import RAW_LINES

    usual = {
        "InvoiceNo": "1", "StockCode": "A", "Description": "thing", "Quantity": 1,
        "InvoiceDate": datetime(2011, 1, 1), "UnitPrice": 1.0, "CustomerID": 1.0, "Country": "France",
    }

    def make(rows):
        return spark.createDataFrame([tuple({**usual, **r}.values()) for r in rows], RAW_LINES)

    return make
