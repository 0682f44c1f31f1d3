"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from patronlens.plans.catalogue import QUERIES
from patronlens.session import local_session

HEADLINE = [
    "clean_audit", "kpis", "top_countries", "monthly_revenue", "describe_rfm", "rfm_table", "rfm_scores",
    "level_distribution", "quantile_thresholds", "rfm_histograms", "rfm_density", "robust_features",
    "fixed_center_assignment", "silhouette_squared", "k_sweep", "rule_segments", "segment_summary",
    "strategy_report", "pca_projection", "kmeans_segments", "kmeans_sweep",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["rfm_scores"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
