from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from patronlens.functions import quantiles
from patronlens.functions.quantiles import Target, exact_quantiles, order_statistics

STEPS = [0.0, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 0.8, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize(
    "values",
    [
        [float(v) for v in range(1, 12)],
        [7.5] * 40,
        # One value holds a third of the rows, and another nearly as many.
        [3.0] * 500 + [2.5] * 400 + [i / 7 for i in range(600)],
        [float(i % 3) for i in range(100)],
        [-1e12, -2.5, 0.0, 1e-9, 4.0, 1e12],
    ],
)
def test_quantiles_equal_numpy(spark, values):
    found = exact_quantiles(frame(spark, values), {"v": STEPS})["v"]
    assert found == pytest.approx(list(np.quantile(values, STEPS)), rel=1e-12, abs=1e-12)


def test_many_ranges_and_several_columns(spark):
    random.seed(5)
    values = [round(random.lognormvariate(5, 2), 2) for _ in range(20_000)] + [99.5] * 10_000
    df = frame(spark, values).withColumn("w", -F.col("v"))
    found = exact_quantiles(df, {"v": STEPS, "w": [0.5]})
    assert found["v"] == pytest.approx(list(np.quantile(values, STEPS)), rel=1e-12)
    assert found["w"] == [-found["v"][STEPS.index(0.5)]]


def test_missing_values_do_not_count(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, {"v": [0.5]})["v"] == [2.0]
    assert exact_quantiles(df.where("v > 5"), {"v": [0.5]})["v"] == [None]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60), data=st.data())
def test_any_rank_of_any_values(spark, values, data):
    rank = data.draw(st.integers(0, len(values) - 1))
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    target = Target(F.lit(True), [rank])
    assert order_statistics(df, "v", [target]) == [{rank: sorted(values)[rank]}]


def test_targets_may_look_at_different_rows(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(200)], "g int, v bigint")
    targets = [Target(F.col("g") == 0, [0]), Target(F.col("g") == 2, [150, 151, 199])]
    assert order_statistics(df, "v", targets) == [{0: 0}, {150: 150, 151: 151, 199: 199}]


def test_one_way_for_every_size():
    source = Path(quantiles.__file__).read_text()
    assert "percentile(" not in source and "percentile_approx" not in source


def test_ranks_beyond_a_sketch_are_exact(spark):
    """More values than a sketch holds, a third of them equal, in many tasks; and values next to a hot one."""
    df = spark.range(0, 120_000, 1, 23).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") * 7919 % 120_011 / 120_011).alias("v"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(2.0)).alias("w x"),
    )
    table = df.toPandas()
    found = exact_quantiles(df, {"v": STEPS, "w x": STEPS})
    for column in ("v", "w x"):
        assert found[column] == pytest.approx(list(np.quantile(table[column], STEPS)), rel=1e-13)
    plan_source = Path(quantiles.__file__).read_text()
    assert "repartitionByRange" not in plan_source.split("def _narrowed")[1].split("def _sketch_quantiles")[0]


def test_a_wrong_sketch_only_costs_another_reading(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ERROR", 0.0)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 8)
    values = [float(i * 37 % 1009) for i in range(1009)]
    assert exact_quantiles(frame(spark, values), {"v": STEPS})["v"] == pytest.approx(list(np.quantile(values, STEPS)), rel=1e-13)
