"""Customer value segmentation on Spark.

Retail invoice lines go in; recency / frequency / monetary scores, k-means
segments and the reports built on them come out.  Every step takes DataFrames
and returns DataFrames.
"""

from patronlens.operators.cleaning import clean_lines, cleaning_audit
from patronlens.operators.rfm import build_rfm
from patronlens.operators.scoring import score_customers
from patronlens.plans.pipelines import VARIANTS, scored_customers, segment_customers
from patronlens.sources.csv_lines import read_lines_csv, union_sources

__all__ = [
    "VARIANTS", "build_rfm", "clean_lines", "cleaning_audit", "read_lines_csv", "score_customers",
    "scored_customers", "segment_customers", "union_sources",
]
