from __future__ import annotations

from datetime import datetime

from patronlens.operators.cleaning import clean_lines, cleaning_audit
from patronlens.operators.profiling import describe, missing_counts, preview, schema_listing, top_countries


def invoices(df):
    return sorted(r["InvoiceNo"] or "" for r in df.collect())


def test_rules_keep_and_drop(make_lines):
    nan = float("nan")
    lines = make_lines(
        [
            {"InvoiceNo": "ok"},
            {"InvoiceNo": None},
            {"InvoiceNo": "c-lower"},
            {"InvoiceNo": "C1"},
            {"InvoiceNo": "no-customer", "CustomerID": None},
            {"InvoiceNo": "nan-customer", "CustomerID": nan},
            {"InvoiceNo": "nan-price", "UnitPrice": nan},
            {"InvoiceNo": "no-price", "UnitPrice": None},
            {"InvoiceNo": "free", "UnitPrice": 0.0},
            {"InvoiceNo": "below", "UnitPrice": -1.0},
            {"InvoiceNo": "none", "Quantity": 0},
            {"InvoiceNo": "returned", "Quantity": -2},
            {"InvoiceNo": "unknown", "Quantity": None},
        ]
    )
    assert invoices(clean_lines(lines)) == ["", "c-lower", "ok"]
    audit = {r["rule"]: (r["rows_before"], r["rows_after"], r["rows_removed"]) for r in cleaning_audit(lines).collect()}
    assert audit == {
        "has_customer": (13, 11, 2), "not_cancelled": (11, 10, 1), "positive_amount": (10, 3, 7),
    }


def test_nan_quantity_is_dropped(spark):
    lines = spark.createDataFrame(
        [("1", float("nan"), 1.0, 5.0), ("2", 2.0, 1.5, 5.0)],
        "InvoiceNo string, Quantity double, UnitPrice double, CustomerID double",
    )
    rows = clean_lines(lines).collect()
    assert [(r["InvoiceNo"], r["TotalPrice"], r["CustomerID"]) for r in rows] == [("2", 3.0, 5)]


def test_equal_lines_are_kept_and_ids_become_whole(make_lines):
    clean = clean_lines(make_lines([{"CustomerID": 13085.0, "Quantity": 3, "UnitPrice": 2.5}] * 2))
    rows = clean.collect()
    assert [(r["CustomerID"], r["TotalPrice"]) for r in rows] == [(13085, 7.5), (13085, 7.5)]
    assert dict(clean.dtypes)["CustomerID"] == "bigint"


def test_missing_counts_see_null_and_nan(make_lines):
    lines = make_lines([{"CustomerID": None}, {"CustomerID": float("nan")}, {"Country": None}])
    found = {r["column"]: r["missing"] for r in missing_counts(lines).collect()}
    assert found["CustomerID"] == 2 and found["Country"] == 1 and found["InvoiceNo"] == 0


def test_describe_leaves_nan_out(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(float("nan"),), (None,)], "v double")
    (row,) = describe(df, ["v"]).collect()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (4, 2.5, 1.0, 4.0)
    assert (row["q25"], row["q50"], row["q75"]) == (1.75, 2.5, 3.25)
    assert abs(row["std"] - 1.2909944487358056) < 1e-12


def test_top_countries_ties_go_by_name(make_lines):
    lines = make_lines([{"Country": c} for c in ["Spain", "Italy", "Italy", "Spain", "Japan", None, None, None]])
    assert [(r["Country"], r["lines"]) for r in top_countries(lines, 2).collect()] == [("Italy", 2), ("Spain", 2)]


def test_schema_listing_and_preview(make_lines):
    lines = make_lines([{"InvoiceNo": str(i)} for i in (3, 1, 2)])
    assert [r["type"] for r in schema_listing(lines).collect()][3:6] == ["bigint", "timestamp_ntz", "double"]
    assert [r["InvoiceNo"] for r in preview(lines, ["InvoiceNo"], 2).collect()] == ["1", "2"]


def test_filters_reach_the_parquet_scan(spark, make_lines, tmp_path):
    path = str(tmp_path / "lines")
    make_lines([{"InvoiceDate": datetime(2011, 1, 1)}]).write.parquet(path)
    clean = clean_lines(spark.read.parquet(path)).select("CustomerID", "TotalPrice")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = clean._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThan(Quantity,0)" in pushed and "GreaterThan(UnitPrice,0.0)" in pushed
    assert "StringStartsWith(InvoiceNo,C)" in pushed
    assert "Country" not in plan and "Description" not in plan
