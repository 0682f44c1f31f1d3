from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.functions.columns import half_even
from patronlens.operators.cleaning import clean_lines
from patronlens.operators.rfm import build_rfm, customer_totals
from patronlens.operators.scoring import level_of, score_customers


def rfm_of(df):
    return {r["CustomerID"]: (r["Recency"], r["Frequency"], round(r["Monetary"], 2)) for r in df.collect()}


def test_recency_counts_whole_days(make_lines):
    clean = clean_lines(make_lines([{"InvoiceDate": datetime(2011, 12, 8, 18)}]))
    assert rfm_of(build_rfm(clean, datetime(2011, 12, 10, 9)))[1][0] == 1
    assert rfm_of(build_rfm(clean, datetime(2011, 12, 8, 9)))[1][0] == -1
    assert rfm_of(build_rfm(clean))[1][0] == 1


@pytest.mark.parametrize("zone", ["UTC", "Europe/London", "America/New_York"])
def test_recency_ignores_the_session_time_zone(spark, make_lines, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        clean = clean_lines(make_lines([{"InvoiceDate": datetime(2011, 3, 26, 12)}]))
        assert rfm_of(build_rfm(clean, datetime(2011, 3, 27, 12)))[1][0] == 1
        assert rfm_of(build_rfm(clean, datetime(2011, 3, 27, 11, 59, 59)))[1][0] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_missing_invoice_is_not_counted_but_its_money_is(make_lines):
    lines = make_lines(
        [{"InvoiceNo": "a", "UnitPrice": 2.0}, {"InvoiceNo": "a"}, {"InvoiceNo": None}, {"InvoiceNo": "b"}]
    )
    assert rfm_of(build_rfm(clean_lines(lines)))[1] == (1, 2, 5.0)


def test_no_lines_no_snapshot(make_lines):
    with pytest.raises(ValueError, match="no clean lines"):
        build_rfm(clean_lines(make_lines([{"UnitPrice": -1.0}])))


def test_a_hot_customer_is_spread_over_the_first_shuffle(make_lines):
    totals = customer_totals(clean_lines(make_lines([{}])))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("CustomerID" in e and "InvoiceNo" in e for e in exchanges)


def scores_by_definition(rows):
    """Scores from what they mean: edges below a value, and places in an order."""
    steps = (0.2, 0.4, 0.6, 0.8)

    def by_edges(column):
        values = [row[column] for row in rows]
        edges = np.quantile(values, steps)
        return {row[0]: 1 + int(sum(edge < row[column] for edge in edges)) for row in rows}

    in_order = sorted((row[2], row[0]) for row in rows)
    last = len(rows) - 1
    by_place = {key: 1 + sum(place > last * step for step in steps) for place, (_, key) in enumerate(in_order)}
    recency, monetary = by_edges(1), by_edges(3)
    out = {}
    for key, *_ in rows:
        total = recency[key] + by_place[key] + monetary[key]
        level = "Low" if total < 7 else "Mid" if total < 10 else "High" if total < 13 else "Champion"
        out[key] = (recency[key], by_place[key], monetary[key], level)
    return out


def spark_scores(df, **options):
    return {
        r["CustomerID"]: (r["R_Score"], r["F_Score"], r["M_Score"], r["Customer_Level"])
        for r in score_customers(df, **options).collect()
    }


@pytest.mark.parametrize("n", [6, 7, 11, 16, 53, 201, 501])
def test_scores_by_definition(make_rfm, n):
    random.seed(n)
    ids = random.sample(range(10_000), n)
    recency = random.sample(range(3 * n), n)
    # A third of the customers share one frequency.
    rows = [
        (i, r, 1 if random.random() < 0.4 else random.randint(1, 6), round(random.expovariate(0.01) + 1, 2))
        for i, r in zip(ids, recency)
    ]
    assert spark_scores(make_rfm(rows)) == scores_by_definition(rows)


def test_frequency_ranks_are_not_ntile(make_rfm):
    rows = [(i, i, i, float(i)) for i in range(1, 8)]
    assert [s[1] for _, s in sorted(spark_scores(make_rfm(rows)).items())] == [1, 1, 2, 3, 4, 5, 5]


def test_all_frequencies_equal_split_by_customer(make_rfm):
    rows = [(i, i, 4, float(i)) for i in range(10, 0, -1)]
    assert [s[1] for _, s in sorted(spark_scores(make_rfm(rows)).items())] == [
        1, 1, 2, 2, 3, 3, 4, 4, 5, 5,
    ]


def test_coinciding_edges_raise_or_drop(make_rfm):
    values = [1] * 8 + [2, 3]
    rows = [(i, v, i, float(i)) for i, v in enumerate(values)]
    with pytest.raises(ValueError, match="Recency has coinciding"):
        score_customers(make_rfm(rows))
    scores = spark_scores(make_rfm(rows), duplicates="drop")
    assert [scores[i][0] for i in range(10)] == [1] * 8 + [2, 2]
    scores = spark_scores(make_rfm(rows), duplicates="drop", recency_order="descending")
    assert [scores[i][0] for i in range(10)] == [2] * 8 + [1, 1]


def test_recent_customers_may_score_high(make_rfm):
    rows = [(i, i, i, float(i)) for i in range(1, 11)]
    up, down = spark_scores(make_rfm(rows)), spark_scores(make_rfm(rows), recency_order="descending")
    assert all(up[i][0] + down[i][0] == 6 for i in up)


def test_labels_replace_numbers_but_not_levels(make_rfm):
    rows = [(i, i, i, float(i)) for i in range(1, 11)]
    labelled = score_customers(make_rfm(rows), labels=["e", "d", "c", "b", "a"]).collect()
    plain = {r["CustomerID"]: r for r in score_customers(make_rfm(rows)).collect()}
    for row in labelled:
        numbers = plain[row["CustomerID"]]
        assert row["RFM_Score"] == "".join("edcba"[int(n) - 1] for n in numbers["RFM_Score"])
        assert row["Customer_Level"] == numbers["Customer_Level"]
    with pytest.raises(ValueError, match="labels"):
        score_customers(make_rfm(rows), labels=["a"])
    with pytest.raises(ValueError, match="unknown option"):
        score_customers(make_rfm(rows), duplicates="keep")


def test_levels(spark):
    totals = spark.createDataFrame([(t,) for t in (3, 6, 7, 9, 10, 12, 13, 15, 0, 16)], "total int")
    found = [r[0] for r in totals.orderBy("total").select(level_of(F.col("total"))).collect()]
    assert found == [None, "Low", "Low", "Mid", "Mid", "High", "High", "Champion", "Champion", None]


def test_half_even(spark):
    values = [(2.5, 0, 2.0), (0.125, 2, 0.12), (1.255, 2, 1.25), (2.675, 2, 2.68), (-0.5, 0, -0.0)]
    for value, digits, expected in values:
        (row,) = spark.range(1).select(half_even(F.lit(value), digits)).collect()
        assert row[0] == expected


def test_scoring_never_gathers_customers_in_one_task(make_rfm, tmp_path, spark):
    make_rfm([(i, i, i % 7, float(i)) for i in range(100)]).write.parquet(str(tmp_path / "rfm"))
    scored = score_customers(spark.read.parquet(str(tmp_path / "rfm")))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_sketched_frequencies_stay_within_their_error(spark):
    from patronlens.operators.rfm import monthly_sketches, totals_of_months

    # Customer 1 has 20,000 invoices, each in two months; customer 2 has three.
    lines = spark.range(40_000).selectExpr(
        "1L AS CustomerID", "concat('i', id % 20000) AS InvoiceNo", "1.0D AS TotalPrice",
        "CAST(IF(id < 20000, '2011-01-05', '2011-02-05') AS TIMESTAMP_NTZ) AS InvoiceDate",
    ).unionByName(spark.range(3).selectExpr(
        "2L AS CustomerID", "concat('j', id) AS InvoiceNo", "2.0D AS TotalPrice", "TIMESTAMP_NTZ'2011-02-01' AS InvoiceDate"
    ))
    months = monthly_sketches(lines)
    found = {r["CustomerID"]: r for r in totals_of_months(months).collect()}
    assert abs(found[1]["Frequency"] - 20_000) < 4 * 0.0163 * 20_000
    assert found[2]["Frequency"] == 3 and found[1]["Monetary"] == 40_000
    only = totals_of_months(months, last="2011-01").collect()
    assert [r["CustomerID"] for r in only] == [1] and only[0]["Monetary"] == 20_000
    assert totals_of_months(monthly_sketches(lines.limit(0))).count() == 0
