from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from patronlens.operators import clustering, distributions, reports, segments
from patronlens.operators.clustering import _lloyd_sums, Centers, best_k, business_k, by_mean_monetary, fit_checks, fit_kmeans, measure
from patronlens.operators.features import FEATURES, fit_robust, fit_standard, scaling_check
from patronlens.operators.projection import fit_components
from patronlens.operators.quality import quality_checks
from patronlens.operators.silhouette import _cells, plain_silhouette, silhouette
from patronlens.plans.pipelines import VARIANTS, segment_customers
from patronlens.operators.scoring import score_customers


def points_frame(spark, points, clusters=None):
    rows = [(i, *map(float, p), *( [clusters[i]] if clusters else [] )) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, R double, F double, M double" + (", Cluster int" if clusters else ""))


def blobs(seed=1, sizes=(60, 40, 25), at=((0, 0, 0), (9, 9, 0), (0, 9, 9))):
    rng = np.random.default_rng(seed)
    points = [rng.normal(c, 0.6, 3) for c, n in zip(at, sizes) for _ in range(n)]
    return points, [i for i, n in enumerate(sizes) for _ in range(n)]


def brute_silhouette(points, clusters, power):
    total = 0.0
    for i, p in enumerate(points):
        means = {}
        for c in set(clusters):
            others = [sum((a - b) ** 2 for a, b in zip(p, q)) ** power
                      for j, q in enumerate(points) if clusters[j] == c and j != i]
            means[c] = sum(others) / len(others) if others else None
        own = means.pop(clusters[i])
        if own is None:
            continue
        nearest = min(means.values())
        total += (nearest - own) / max(nearest, own) if max(nearest, own) else 0.0
    return total / len(points)


# -- features ------------------------------------------------------------------


def test_standard_scaling_uses_population_deviation(make_rfm):
    rfm = make_rfm([(i, i, 5, float(i)) for i in range(6)])
    scaling = fit_standard(rfm)
    assert scaling.scale[0] == pytest.approx(1.7078251276599330)
    assert scaling.scale[1] == 1.0
    check = {r["feature"]: (r["mean"], r["std"]) for r in scaling_check(scaling.apply(rfm)).collect()}
    assert check["F"] == (0.0, 0.0)
    assert check["R"][0] == pytest.approx(0.0) and check["R"][1] == pytest.approx(math.sqrt(6 / 5))


def test_robust_scaling_keeps_a_feature_without_spread(make_rfm):
    rfm = make_rfm([(i, i, 9 if i == 5 else 2, float(i)) for i in range(6)])
    features = fit_robust(rfm, log=False).apply(rfm).orderBy("CustomerID").collect()
    assert [r["F"] for r in features] == [0, 0, 0, 0, 0, 7]
    assert [r["R"] for r in features] == pytest.approx([-1, -0.6, -0.2, 0.2, 0.6, 1])
    logged = fit_robust(rfm).apply(rfm).where("CustomerID = 5").first()
    assert logged["F"] == pytest.approx(math.log(10 / 3))


# -- clustering ----------------------------------------------------------------


def test_silhouettes_equal_brute_force_and_mllib(spark):
    points, clusters = blobs()
    clusters[3], clusters[70] = 1, 2
    df = points_frame(spark, points, clusters)
    found = silhouette(df)
    assert found == pytest.approx(brute_silhouette(points, clusters, 1.0), abs=1e-12)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    mllib = ClusteringEvaluator(predictionCol="Cluster").evaluate(vectors)
    assert found == pytest.approx(mllib, abs=1e-9)


def test_only_members_score_zero(spark):
    points, clusters = [(0, 0, 0), (1, 0, 0), (9, 0, 0)], [0, 0, 1]
    df = points_frame(spark, points, clusters)
    assert silhouette(df) == pytest.approx(brute_silhouette(points, clusters, 1.0))


def test_plain_silhouette_lies_in_its_bounds(spark):
    points, clusters = blobs(sizes=(300, 200, 100))
    clusters[3], clusters[310] = 1, 2
    # A heavy tail, repeated points and a cluster of one.
    points += [(20.0 * 1.3**i, 0.0, float(i)) for i in range(20)] + [(1.0, 1.0, 1.0)] * 60 + [(50.0, 50.0, 50.0)]
    clusters += [0] * 20 + [1] * 60 + [3]
    df = points_frame(spark, points, clusters)
    exact = brute_silhouette(points, clusters, 0.5)
    widths = []
    for bins in ((2,), (4,), (16,), (64,)):
        found = plain_silhouette(df, bins=bins)
        assert found.low - 1e-9 <= exact <= found.high + 1e-9
        widths.append(found.high - found.low)
    assert widths == sorted(widths, reverse=True) and widths[-1] < 0.01 < widths[0]
    assert plain_silhouette(df, tolerance=0.03, bins=(4, 8, 16, 64)).bins < 64
    assert plain_silhouette(df, tolerance=0.0, bins=(4, 8)).bins == 8


def test_plain_silhouette_takes_points_by_cells(spark):
    points, clusters = blobs(sizes=(30, 20, 10))
    df = points_frame(spark, points * 9, clusters * 9).withColumnRenamed("Cluster", "cluster")
    grids = [{c: [0.0, 1.0, 5.0] for c in "RFM"}, {c: [x / 50 for x in range(-200, 700)] for c in "RFM"}]
    # Copies of a point are compared with the cells once.
    assert _cells(df.select("cluster", *"RFM"), list("RFM"), grids).count() <= 60
    found = plain_silhouette(df, cluster="cluster", bins=(16,))
    exact = brute_silhouette(points * 9, clusters * 9, 0.5)
    assert found.low - 1e-9 <= exact <= found.high + 1e-9


def test_plain_silhouette_of_few_points_is_exact(spark):
    points, clusters = [(0, 0, 0), (1, 0, 0), (9, 0, 0), (9, 1, 0)], [0, 0, 1, 1]
    found = plain_silhouette(points_frame(spark, points, clusters))
    assert found.low == pytest.approx(found.high) == pytest.approx(brute_silhouette(points, clusters, 0.5))
    with pytest.raises(ValueError, match="two clusters"):
        plain_silhouette(points_frame(spark, points, [0] * 4))
    with pytest.raises(ValueError, match="two clusters"):
        plain_silhouette(points_frame(spark, points, clusters).where("false"))


def test_plain_sweep_chooses_k(spark):
    points, clusters = blobs()
    df = points_frame(spark, points)
    fits = fit_kmeans(df, [2, 3, 4], restarts=3)
    sweep = measure(df, fits, metric="plain")
    assert {r["metric"] for r in sweep.collect()} == {"plain"}
    assert best_k(sweep).first()["k"] == 3
    with pytest.raises(ValueError, match="metric"):
        measure(df, fits, metric="cosine")


def test_one_cluster_has_no_silhouette(spark):
    df = points_frame(spark, [(0, 0, 0), (1, 1, 1)], [0, 0])
    with pytest.raises(ValueError, match="two clusters"):
        silhouette(df)


def test_kmeans_finds_blobs_and_repeats(spark):
    points, clusters = blobs()
    df = points_frame(spark, points)
    fits = fit_kmeans(df, [2, 3, 4], restarts=3)
    again = fit_kmeans(df, [3], restarts=3)
    assert sorted(fits[3].points) == sorted(again[3].points)
    assert fits[2].cost > fits[3].cost > fits[4].cost
    found = [r["Cluster"] for r in fits[3].assign(df).orderBy("id").collect()]
    assert len(set(zip(found, clusters))) == 3
    sweep = {r["k"]: r for r in measure(df, fits).collect()}
    assert sweep[3]["inertia"] == pytest.approx(fits[3].cost, rel=1e-9)
    assert best_k(measure(df, fits)).first()["k"] == 3


def test_copies_count_in_fits_but_are_read_once(spark):
    points, _ = blobs()
    once = fit_kmeans(points_frame(spark, points), [3], restarts=2, relative_tol=0.0)[3]
    many = fit_kmeans(points_frame(spark, points * 7), [3], restarts=2, relative_tol=0.0)[3]
    assert np.allclose(once.points, many.points) and many.cost == pytest.approx(7 * once.cost)
    rows = points_frame(spark, points[:50]).groupBy(*"RFM").agg(F.lit(3.0).alias("copies"))
    [(counts, sums, cost)] = _lloyd_sums(rows, [np.zeros((1, 3))])
    assert counts.tolist() == [150.0] and np.allclose(sums, 3 * np.sum(points[:50], 0)) and cost == pytest.approx(3 * np.sum(np.square(points[:50])))


@pytest.mark.parametrize("near_rows", [0, 300, 1 << 20])
def test_one_reading_serves_many_iterations_of_a_fit(spark, monkeypatch, near_rows):
    points = np.random.default_rng(3).normal(size=(3000, 3))
    read, readings = clustering._read, []
    monkeypatch.setattr(clustering, "NEAR_ROWS", near_rows)
    monkeypatch.setattr(clustering, "_read", lambda *given: readings.append(read(*given)) or readings[-1])
    fit = fit_kmeans(points_frame(spark, points), [4], restarts=1, relative_tol=0.0, seeding_rows=300)[4]
    # Plain iterations from the same first centers.
    centers, steps, moved = readings[0][0].points, 0, None
    while moved is None or ((moved - centers) ** 2).sum() > 0:
        centers, steps = centers if moved is None else moved, steps + 1
        own = ((points[:, None] - centers) ** 2).sum(2).argmin(1)
        moved = np.array([points[own == c].mean(0) for c in range(4)])
    assert np.allclose(fit.points, centers, rtol=0, atol=1e-9)
    assert fit.cost == pytest.approx(((points - centers[own]) ** 2).sum(), rel=1e-9)
    assert len(readings) == 1 if near_rows > 3000 else len(readings) < steps / 2 if near_rows else len(readings) >= steps - 1
    assert all(sum(len(r.near) for r in reading) <= 2 * near_rows for reading in readings)


def test_restarts_at_the_same_centers_go_on_as_one(spark, monkeypatch):
    points, _ = blobs()
    read, sizes = clustering._read, []
    monkeypatch.setattr(clustering, "_read", lambda packed, fits, *given: sizes.append(len(fits)) or read(packed, fits, *given))
    one = fit_kmeans(points_frame(spark, points), [3], restarts=1, relative_tol=0.0)[3]
    fit = fit_kmeans(points_frame(spark, points), [3], restarts=10, relative_tol=0.0)[3]
    assert max(sizes) < 10 and fit.cost <= one.cost * (1 + 1e-12)


def test_members_nearest_elsewhere_are_counted_without_repeating_distances(spark):
    df = points_frame(spark, [(0, 0, 0), (1, 0, 0), (9, 0, 0)])
    centers = Centers([(float(i), 0.0, 0.0) for i in range(10)])
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(type(df), "count", lambda self: pytest.fail("counted behind a filter"))
        row = fit_checks(df, {10: centers}, {10: centers}).first()
    assert (row["not_nearest"], row["empty_clusters"]) == (0, 7)


def test_checks_of_a_fit_and_of_a_bad_one(spark):
    points, _ = blobs()
    df = points_frame(spark, points)
    fits = fit_kmeans(df, [2, 3], restarts=3, relative_tol=0.0)
    rivals = {k: Centers([(float(i), 1.0, 0.0) for i in range(k)]) for k in fits}
    for row in fit_checks(df, fits, rivals).collect():
        assert row["customers"] == len(points) and sum(row[2:]) == 0
    bad = Centers([*fits[2].points, (1e6, 1e6, 1e6)])
    row = {r["k"]: r for r in fit_checks(df, {3: bad}, {3: fits[3]}).collect()}[3]
    assert row["empty_clusters"] == 1 and row["dearer_than_rival"] == 1


def test_logarithm_of_a_late_purchase_is_a_clear_error(make_rfm):
    with pytest.raises(ValueError, match="snapshot"):
        fit_robust(make_rfm([(1, -1, 1, 5.0), (2, 3, 2, 6.0)]))


def test_equally_near_centers_go_to_the_first(spark):
    df = points_frame(spark, [(0, 0, 0)])
    centers = Centers([(1, 0, 0), (-1, 0, 0)])
    assert centers.assign(df).first()["Cluster"] == 0
    row = Centers([(3, 4, 0)]).assign(df, cost="cost").first()
    assert (row["Cluster"], row["cost"]) == (0, 25.0)


def sweep_table(spark, scores):
    return spark.createDataFrame([(k, 1.0, s) for k, s in scores.items()], "k int, inertia double, silhouette double")


@pytest.mark.parametrize(
    "scores, best, business",
    [
        ({2: 0.5, 3: 0.45, 4: 0.41, 5: 0.3}, 2, 4),
        ({2: 0.5, 3: 0.5, 4: 0.39}, 2, 3),
        ({2: -0.3, 3: -0.1, 4: -0.2}, 3, 3),
        ({2: 0.0, 3: -0.1}, 2, 2),
    ],
)
def test_choice_of_k(spark, scores, best, business):
    sweep = sweep_table(spark, scores)
    assert best_k(sweep).first()["k"] == best
    assert business_k(sweep).first()["k"] == business


def test_cluster_ids_follow_mean_spend(make_rfm):
    df = make_rfm([(i, 1, 1, float(i)) for i in range(30)]).selectExpr("*", "0D AS R", "0D AS F", "Monetary AS M")
    centers = by_mean_monetary(df, Centers([(0, 0, 5), (0, 0, 25), (0, 0, 15)]))
    assert [p[2] for p in centers.points] == [25, 15, 5]


def test_components_match_the_covariance_matrix(spark):
    points, _ = blobs(seed=4)
    df = points_frame(spark, points)
    found = fit_components(df)
    values, vectors = np.linalg.eigh(np.cov(np.array(points).T))
    order = values.argsort()[::-1][:2]
    assert found.variance_ratio == pytest.approx(list(values[order] / values.sum()))
    for loading, column in zip(found.loadings, vectors.T[order]):
        column = column * np.sign(column[abs(column).argmax()])
        assert loading == pytest.approx(list(column))
    projected = found.project(df).agg(F.avg("PC1"), F.avg("PC2"), F.var_samp("PC1")).first()
    assert projected[0] == pytest.approx(0) and projected[1] == pytest.approx(0)
    assert projected[2] == pytest.approx(values[order[0]])


# -- names and reports -----------------------------------------------------------


def means_frame(spark, rows):
    return spark.createDataFrame(rows, "Cluster int, Recency double, Frequency double, Monetary double")


@pytest.mark.parametrize(
    "k, names",
    [
        (2, ["Champions", "Hibernating"]),
        (3, ["Champions", "Loyal", "Hibernating"]),
        (4, ["Champions", "Loyal", "New", "Hibernating"]),
        (6, ["Champions", "Loyal", "New", "New", "New", "Hibernating"]),
    ],
)
def test_rank_names(spark, k, names):
    means = means_frame(spark, [(c, 1.0, 1.0, 100.0 - c) for c in range(k)])
    assert [r["Segment"] for r in segments.rank_names(means).orderBy("spend_rank").collect()] == names


def test_rule_names_take_the_first_rule(spark):
    quartiles = {"Recency": [10.0, 20.0, 30.0], "Frequency": [1.0, 2.0, 3.0], "Monetary": [1.0, 50.0, 100.0]}
    means = means_frame(
        spark,
        [(0, 5.0, 9.0, 200.0), (1, 40.0, 9.0, 200.0), (2, 5.0, 1.0, 20.0), (3, 40.0, 1.0, 20.0),
         (4, 15.0, 2.0, 50.0), (5, 10.0, 1.0, 100.0), (6, 41.0, 1.0, 20.0)],
    )
    found = {r["Cluster"]: r["Segment_Name"] for r in segments.rule_names(means, quartiles).collect()}
    assert found == {
        0: "Champions", 1: "At-Risk VIP", 2: "New Customers", 3: "Hibernating", 4: "Regular", 5: "Regular",
        6: "Hibernating",
    }


def test_levels_without_customers_are_listed(make_rfm):
    scored = make_rfm([(1, 5, 2, 3.0)]).withColumn("Customer_Level", F.lit("Mid"))
    counts = [(r["Customer_Level"], r["customers"]) for r in distributions.level_counts(scored).collect()]
    assert counts == [("Champion", 0), ("High", 0), ("Mid", 1), ("Low", 0)]
    profile = {r["Customer_Level"]: r["Recency"] for r in distributions.level_profile(scored).collect()}
    assert profile == {"Low": None, "Mid": 5.0, "High": None, "Champion": None}


def test_radar_scales_and_a_zero_maximum(make_rfm):
    customers = make_rfm([(1, 0, 2, 4.0), (2, 10, 4, 8.0)]).withColumn("Cluster", F.col("CustomerID").cast("int"))
    found = {r["Cluster"]: (r["R"], r["F"], r["M"]) for r in reports.radar_profile(customers, "Cluster").collect()}
    assert found == {1: (2.0, 3.0, 3.0), 2: (-2.0, 5.0, 5.0)}
    five = reports.radar_profile(customers, "Cluster", recency_scale="one_to_five").collect()
    assert [r["R"] for r in five] == [5.0, 1.0]
    recent = customers.where("CustomerID = 1")
    assert reports.radar_profile(recent, "Cluster").first()["R"] is None


@pytest.mark.parametrize("values", [[1, 2, 3, 50, 51], [7, 7, 7], [0, 50, 100, 49, 99, 98, 1]])
def test_histogram_equals_numpy(make_rfm, values):
    rfm = make_rfm([(i, v, 1, float(v)) for i, v in enumerate(values)])
    rows = distributions.histogram(rfm, ["Recency"]).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=np.histogram_bin_edges(values, 50))
    assert [r["customers"] for r in rows] == list(counts)
    assert [r["bin_start"] for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_many_edge_values_equals_numpy(make_rfm):
    random.seed(3)
    values = [random.randint(0, 373) for _ in range(3000)]
    rows = distributions.histogram(make_rfm([(i, v, 1, 1.0) for i, v in enumerate(values)]), ["Recency"])
    counts, _ = np.histogram(values, bins=np.linspace(min(values), max(values), 51))
    assert [r["customers"] for r in rows.orderBy("bin").collect()] == list(counts)


def test_density_integrates_to_about_one(make_rfm):
    random.seed(8)
    values = [random.gauss(50, 9) for _ in range(800)]
    rows = distributions.density_curve(make_rfm([(i, 1, 1, v) for i, v in enumerate(values)]), ["Monetary"])
    curve = rows.orderBy("point").collect()
    step = curve[1]["x"] - curve[0]["x"]
    assert sum(r["density"] for r in curve) * step == pytest.approx(1, abs=0.02)
    h = np.std(values, ddof=1) * len(values) ** -0.2
    expected = np.mean(np.exp(-0.5 * ((curve[60]["x"] - np.array(values)) / h) ** 2) / (h * math.sqrt(2 * math.pi)))
    assert curve[60]["density"] == pytest.approx(expected)


def test_funnel_stages_are_counts_not_nested(make_rfm):
    rfm = make_rfm([(1, 89, 1, 1.0), (2, 90, 2, 2.0), (3, 10, 3, 3.0), (4, 400, 1, 100.0)])
    assert [r["customers"] for r in distributions.funnel(rfm).orderBy("stage_order").collect()] == [4, 2, 4, 2, 1]


def test_segment_shares_follow_the_rounded_totals(make_rfm):
    rows = [(1, 1, 1, 10.004), (2, 2, 3, 10.004), (3, 3, 1, 20.0)]
    named = make_rfm(rows).withColumn("Segment_Name", F.when(F.col("CustomerID") < 3, "a").otherwise("b"))
    summary = {r["Segment_Name"]: r for r in reports.segment_summary(named).collect()}
    assert summary["a"]["Total_Revenue"] == 20.01 and summary["a"]["Pct_Customers"] == 66.7
    assert summary["a"]["Avg_Monetary"] == 10.0 and summary["b"]["Pct_Revenue"] == 50.0


def test_strategy_report_takes_other_texts(make_rfm, spark):
    clustered = make_rfm([(i, 1, 1, 10.0 * i) for i in range(1, 9)]).withColumn(
        "Cluster", (F.col("CustomerID") % 4).cast("int")
    )
    report = reports.strategy_report(clustered)
    assert [r["Segment"] for r in report.orderBy(F.desc("Revenue")).collect()] == segments.RANK_NAMES
    own = spark.createDataFrame([("Champions", "call", "more")], "Segment string, Strategy string, Expected_Impact string")
    rows = reports.strategy_report(clustered, own).collect()
    assert len(rows) == 4 and [r["Strategy"] for r in rows].count("call") == 1


def test_quality_checks_report_failures(make_rfm, spark):
    scored = make_rfm([(1, 1, 1, -5.0), (2, 1, 1, 5.0)]).withColumn(
        "RFM_Score", F.when(F.col("CustomerID") == 1, F.lit("111"))
    )
    clean = spark.createDataFrame([], "CustomerID long")
    sweep = sweep_table(spark, {2: -0.1})
    found = {r["check"]: r["failed_rows"] for r in quality_checks(clean, scored.drop("Recency"), sweep).collect()}
    assert found == {
        "line_columns_present": 1, "clean_lines_remain": 1, "rfm_columns_present": 1, "monetary_positive": 1,
        "rfm_score_present": 1, "best_silhouette_positive": 1,
    }


@pytest.mark.parametrize("variant", list(VARIANTS))
def test_variants_name_every_customer(make_rfm, variant):
    random.seed(2)
    rows = [(i, 3 * i + 1, random.randint(1, 9), round(random.expovariate(0.01), 2) + 1) for i in range(80)]
    scored = score_customers(make_rfm(rows))
    settings = {**VARIANTS[variant], **({"ks": range(2, 5)} if "k" not in VARIANTS[variant] else {})}
    result = segment_customers(scored, **settings, restarts=2)
    assert result.customers.where("Segment_Name IS NULL").count() == 0
    assert result.customers.count() == 80
    means = {r["Cluster"]: r["m"] for r in result.customers.groupBy("Cluster").agg(F.avg("Monetary").alias("m")).collect()}
    assert [means[c] for c in sorted(means)] == sorted(means.values(), reverse=True)


def test_density_equals_the_sum_of_kernels(spark):
    """A heavy tail, ties and far values: within the stated bound of the direct sum, without Python in the plan."""
    draw = np.random.default_rng(3)
    values = np.concatenate([draw.lognormal(3, 1.5, 4000), np.full(2000, 20.0), [50_000.0, -3000.0]])
    curve = distributions.density_curve(spark.createDataFrame([(float(v),) for v in values], "v double"), ["v"])
    width = values.std(ddof=1) * len(values) ** -0.2
    for row in curve.collect():
        kernels = np.exp(-0.5 * ((row["x"] - values) / width) ** 2)
        assert abs(row["density"] * len(values) * width * math.sqrt(2 * math.pi) - kernels.sum()) < 2e-12 * len(values)
    assert "InArrow" not in curve._jdf.queryExecution().toString()


def test_scatter_sample_is_the_same_for_any_partitioning(spark):
    named = spark.range(3000).select(
        F.col("id").alias("CustomerID"), F.lit(1).alias("Recency"), F.lit(1).alias("Frequency"), F.lit(1.0).alias("Monetary"),
        F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2995, "cold").when(F.col("id") < 2998, "rare").alias("Segment_Name"),
    )
    for size in (1, 7, 1200):
        samples = [
            sorted((r["Segment_Name"] or "", r["CustomerID"]) for r in reports.scatter_sample(n, size).collect())
            for n in (named.coalesce(1), named.repartition(13, "CustomerID"))
        ]
        assert samples[0] == samples[1]
        expected = []
        for segment, ids in (("hot", range(2500)), ("cold", range(2500, 2995)), ("rare", range(2995, 2998)), ("", range(2998, 3000))):
            expected += [(segment, i) for i in sorted(ids, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:size]]
        assert samples[0] == sorted(expected)
    assert reports.scatter_sample(named.limit(0)).count() == 0
