"""Two principal components of the scaled features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from patronlens.operators.features import FEATURES


@dataclass(frozen=True)
class Components:
    means: Sequence[float]
    loadings: Sequence[Sequence[float]]
    variance_ratio: Sequence[float]

    def project(self, features: DataFrame) -> DataFrame:
        """Adds PC1, PC2, ... as arithmetic on the feature columns."""
        offsets = [F.col(c) - F.lit(m) for c, m in zip(FEATURES, self.means)]
        columns = {}
        for number, loading in enumerate(self.loadings, start=1):
            terms = [o * F.lit(w) for o, w in zip(offsets, loading)]
            columns[f"PC{number}"] = sum(terms[1:], terms[0])
        return features.withColumns(columns)


def fit_components(features: DataFrame, components: int = 2) -> Components:
    """MLlib reduces the rows to one small covariance matrix.

    The sign of a component is free; here its largest loading is positive.
    """
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features.select(*FEATURES))
    model = PCA(k=components, inputCol="features", outputCol="projected").fit(vectors)
    loadings = []
    for column in model.pc.toArray().T:
        sign = 1.0 if column[abs(column).argmax()] >= 0 else -1.0
        loadings.append([float(sign * w) for w in column])
    means = features.agg(*[F.avg(c).alias(c) for c in FEATURES]).first()
    return Components([means[c] for c in FEATURES], loadings, [float(v) for v in model.explainedVariance])
