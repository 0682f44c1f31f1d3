from __future__ import annotations

import pytest

from patronlens.plans.catalogue import QUERIES
from patronlens.plans.oracles import ORACLES
from oracle import TESTDATA, connect, spark_result, sql_result

FOLDER = TESTDATA / "sf0.001"
CHECKED = sorted(ORACLES)
UNCHECKED = sorted(set(QUERIES) - set(CHECKED))


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    expected = sql_result(duck, ORACLES[name])
    assert spark_result(QUERIES[name](spark, str(FOLDER))) == expected


def test_only_kmeans_has_no_sql():
    assert UNCHECKED == ["kmeans_segments", "kmeans_sweep", "notebook_segments", "verify_segments"]


def test_kmeans_segments(spark):
    rows = QUERIES["kmeans_segments"](spark, str(FOLDER)).collect()
    assert len(rows) == 150
    assert {r["Cluster"] for r in rows} == {0, 1, 2, 3}
    assert {(r["Cluster"], r["Segment_Name"]) for r in rows} == {
        (0, "Champions"), (1, "Loyal"), (2, "New"), (3, "Hibernating"),
    }


@pytest.mark.parametrize(
    "folder, ascending, descending",
    [
        ("sf0.001", (18, 75, 44, 13), (45, 36, 39, 30)),
        ("sf0.01", (265, 566, 513, 156), (405, 402, 407, 286)),
        ("sf0.1", (2828, 5518, 5106, 1545), (3869, 4249, 4246, 2633)),
    ],
)
def test_known_level_counts(spark, folder, ascending, descending):
    from patronlens.operators.distributions import level_counts
    from patronlens.operators.scoring import score_customers
    from patronlens.plans.catalogue import _rfm

    rfm = _rfm(spark, str(TESTDATA / folder))
    for order, expected in (("ascending", ascending), ("descending", descending)):
        counts = {r["Customer_Level"]: r["customers"] for r in level_counts(
            score_customers(rfm, recency_order=order)).collect()}
        assert tuple(counts[name] for name in ("Low", "Mid", "High", "Champion")) == expected
