"""Mean silhouette of a clustering, with squared or with plain Euclidean distances.

The mean squared distance from a point to a cluster is its squared distance to the
cluster mean plus the cluster's variance, so the exact score of every row needs two
passes and no pairs.

Plain distances have no such identity, and all pairs of rows are out of the question.  Spark
counts the rows of every cell of a grid and cluster, with their mean and variance.  The
mean distance from a point to a cell's rows is at least its distance D to their mean (distance
is convex) and at most sqrt(D^2 + variance) (the mean of squares bounds the square of the mean).
The points are not taken one by one either but by the cells of the finest grid, whose rows'
mean score is bounded in the same way: mean distances as above with both variances, and what the
score is bent between them by at most the cell's variance over the squared distance.  The
grid is made finer until the bounds are close.  Cells of equal rows are exact.  So the work is
bounded by the grids, not by the rows, of which every grid needs one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from patronlens.operators.features import FEATURES
from patronlens.sources.stages import released, stage

TOLERANCE = 0.005
# Bins a feature, from coarse to fine; each divides the last, so that all edges come from one pass.
BINS = (16, 32, 64)
# Points are taken by cells of so many times the bins of the last grid.
FINER = 2
# Distances computed at a time, and by one task.
_BLOCK, _TASK = 1 << 17, 1 << 30


def cluster_facts(
    clustered: DataFrame, columns: Sequence[str] = tuple(FEATURES), cluster: str = "Cluster"
) -> list[Row]:
    """Size, mean and variance of every cluster: one row per cluster, in cluster order."""
    facts = clustered.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        reduce(add, [F.var_pop(c) for c in columns]).alias("variance"),
    )
    return sorted(facts.collect(), key=lambda f: f["cluster"])


def silhouette(
    clustered: DataFrame,
    columns: Sequence[str] = tuple(FEATURES),
    cluster: str = "Cluster",
    facts: Sequence[Row] | None = None,
) -> float:
    """Exact mean silhouette with squared distances; ``facts`` saves the first pass."""
    facts = cluster_facts(clustered, columns, cluster) if facts is None else facts
    if len(facts) < 2:
        raise ValueError(f"a silhouette needs at least two clusters, got {len(facts)}")
    return (
        clustered.selectExpr(
            f"`{cluster}` AS own_cluster", *[f"{_mean_distance(f, columns)} AS distance_{i}" for i, f in enumerate(facts)]
        )
        .selectExpr(_own(facts), _other(facts))
        .agg(F.avg(_score(F.col("own"), F.col("other"))).alias("mean"))
        .first()["mean"]
    )


def _mean_distance(fact: Row, columns: Sequence[str]) -> str:
    squares = [f"(`{c}` - {fact[f'mean_{c}']!r}D) * (`{c}` - {fact[f'mean_{c}']!r}D)" for c in columns]
    return " + ".join([*squares, f"{fact['variance']!r}D"])


def _own(facts: Sequence[Row]) -> str:
    """Mean distance to the other members; NULL for an only member."""
    cases = [
        f"WHEN {f['cluster']} THEN distance_{i} * {f['rows'] / (f['rows'] - 1)!r}D"
        for i, f in enumerate(facts) if f["rows"] > 1
    ]
    return f"CASE own_cluster {' '.join(cases)} END AS own" if cases else "CAST(NULL AS DOUBLE) AS own"


def _other(facts: Sequence[Row]) -> str:
    """Mean distance to the nearest other cluster."""
    distances = [f"IF(own_cluster <> {f['cluster']}, distance_{i}, NULL)" for i, f in enumerate(facts)]
    return f"least({', '.join(distances)}) AS other"


def _score(own: Column, other: Column) -> Column:
    """(other - own) / max of both; the only member of a cluster scores 0."""
    return F.coalesce((other - own) / F.nullif(F.greatest(own, other), F.lit(0.0)), F.lit(0.0))


# -- plain distances -------------------------------------------------------------


@dataclass(frozen=True)
class Bounded:
    """A mean silhouette that certainly lies between ``low`` and ``high``, from a grid of ``bins`` a feature."""

    low: float
    high: float
    bins: int

    @property
    def score(self) -> float:
        return (self.low + self.high) / 2


def plain_silhouette(
    clustered: DataFrame,
    columns: Sequence[str] = tuple(FEATURES),
    cluster: str = "Cluster",
    *,
    tolerance: float = TOLERANCE,
    bins: Sequence[int] = BINS,
) -> Bounded:
    """Mean silhouette with plain distances, as an interval.

    The grid is refined until the interval is at most ``tolerance`` wide or the last entry of ``bins``
    is reached; the result says how wide it is then.  Executors get at most
    bins^columns cells a cluster, whatever the number of rows; the cells of a grid finer by ``FINER``
    are compared with them once for each grid.
    """
    finest = bins[-1] * FINER // 2
    if any(b < 2 or b % 2 or finest % (b // 2) for b in bins):
        raise ValueError("numbers of bins must be even and divide the last")
    rows = clustered.select(F.col(cluster).alias("cluster"), *columns)
    spread = rows.agg(
        *[F.percentile_approx(c, [i / finest for i in range(finest + 1)], 10 * finest).alias(c) for c in columns],
        *[F.struct(F.min(c).alias("least"), F.max(c).alias("most")).alias(f"ends {c}") for c in columns],
    ).first()
    if spread[columns[0]] is None:
        raise ValueError("a silhouette needs at least two clusters, got 0")

    def edges(column: str, number: int) -> list[float]:
        """Half of them part the rows, half the range, so that neither the middle nor the tails stay coarse."""
        step, (least, most) = finest // number, spread[f"ends {column}"]
        return sorted({*spread[column][step:-1:step], *(least + (most - least) * i / number for i in range(1, number))})

    found = None
    with released():
        groups = stage(_cells(rows, columns, [{c: edges(c, number // 2) for c in columns} for number in (*bins, bins[-1] * FINER)]), "cells")
        for place, number in enumerate(bins):
            found = _bounded(groups, columns, _merged(groups, columns, f"cell_{place}").collect(), number)
            if found.high - found.low <= tolerance:
                break
    return found


def _cells(rows: DataFrame, columns: Sequence[str], grids: Sequence[dict[str, list[float]]]) -> DataFrame:
    """Rows, means, variance and radius around the mean of every occupied cell of the last grid and cluster.

    ``cell_<i>`` numbers the cell of the i-th grid that it lies in; each grid's edges are among those of the next.
    """
    numbers = [f"cell_{i}" for i in range(len(grids))]
    limits = [[np.array(grid[c]) for c in columns] for grid in grids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(1 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(columns))]
            cells = []
            for grid in limits:
                cell = np.zeros(len(batch), np.int64)
                for limit, value in zip(grid, values):
                    cell = cell * (len(limit) + 1) + np.searchsorted(limit, value)
                cells.append(pa.array(cell))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values), *cells], ["cluster", *columns, *numbers])

    shape = f"cluster {rows.schema['cluster'].dataType.simpleString()}, " + ", ".join([*(f"`{c}` double" for c in columns), *(f"{n} long" for n in numbers)])
    sides = [F.greatest(F.max(c) - F.avg(c), F.avg(c) - F.min(c)) for c in columns]
    return rows.mapInArrow(place, shape).groupBy("cluster", *numbers).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        reduce(add, [F.var_pop(c) for c in columns]).alias("variance"),
        F.sqrt(reduce(add, [side * side for side in sides])).alias("radius"),
    )


def _merged(groups: DataFrame, columns: Sequence[str], cell: str) -> DataFrame:
    """Rows, means and variance of the cells of a coarser grid."""
    rows = F.sum("rows")
    means = {c: F.sum(F.col("rows") * F.col(f"mean_{c}")) / rows for c in columns}
    squares = reduce(add, [F.col(f"mean_{c}") * F.col(f"mean_{c}") for c in columns], F.col("variance"))
    variance = F.sum(F.col("rows") * squares) / rows - reduce(add, [m * m for m in means.values()])
    single = F.count(F.lit(1)) == 1
    return groups.groupBy("cluster", cell).agg(
        rows.alias("rows"),
        *[F.when(single, F.first(f"mean_{c}")).otherwise(m).alias(f"mean_{c}") for c, m in means.items()],
        F.when(single, F.first("variance")).otherwise(F.greatest(variance, F.lit(0.0))).alias("variance"),
    )


def _bounded(groups: DataFrame, columns: Sequence[str], cells: list[Row], bins: int) -> Bounded:
    names = [f"mean_{c}" for c in columns]
    clusters = sorted({c["cluster"] for c in cells})
    if len(clusters) < 2:
        raise ValueError(f"a silhouette needs at least two clusters, got {len(clusters)}")
    # For every cluster its cells' means, variances and rows.
    spread = [
        (np.array([[c[n] for n in names] for c in own], float), np.array([c["variance"] for c in own], float), np.array([c["rows"] for c in own], float))
        for own in ([c for c in cells if c["cluster"] == cluster] for cluster in clusters)
    ]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.searchsorted(clusters, batch.column(0).to_numpy())
            rows, variance, radius, *means = (batch.column(i).to_numpy().astype(np.float64) for i in range(1, batch.num_columns))
            low, high = _scores(np.column_stack(means), own, variance, radius, spread)
            yield pa.RecordBatch.from_pydict({"rows": [float(rows.sum())], "low": [float(low @ rows)], "high": [float(high @ rows)]})

    tasks = max(-(-groups.count() * len(cells) // _TASK), 1)
    points = groups.select("cluster", "rows", "variance", "radius", *names).repartition(tasks)
    sums = points.mapInArrow(bounds, "rows double, low double, high double").agg(F.sum("rows"), F.sum("low"), F.sum("high")).first()
    return Bounded(sums[1] / sums[0], sums[2] / sums[0], bins)


def _distances(points: np.ndarray, variance: np.ndarray, spread: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances from the rows of each point's cell to those of each cluster, a row: at least and at most."""
    near, far = np.zeros((len(points), len(spread))), np.zeros((len(points), len(spread)))
    for j, (means, inside, weights) in enumerate(spread):
        for at in range(0, len(means), _BLOCK):
            part = slice(at, at + _BLOCK)
            block = max(_BLOCK // len(means[part]), 1)
            for begin in range(0, len(points), block):
                some = slice(begin, begin + block)
                squared = sum((points[some, i, None] - means[None, part, i]) ** 2 for i in range(points.shape[1]))
                near[some, j] += np.sqrt(squared) @ weights[part]
                squared += inside[part]
                squared += variance[some, None]
                far[some, j] += np.sqrt(squared) @ weights[part]
    return near, far


def _scores(points, own, variance, radius, spread) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest mean score that the rows of each point's cell can have."""
    near, far = _distances(points, variance, spread)
    sizes = np.array([weights.sum() for _, _, weights in spread])
    at = np.arange(len(points))
    alone = sizes[own] == 1
    with np.errstate(divide="ignore", invalid="ignore"):
        own_near, own_far = (d[at, own] / (sizes[own] - 1) for d in (near, far))
        # A mean distance changes by at most so much a unit of way.
        slope = sizes[own] / (sizes[own] - 1)
    near, far = near / sizes, far / sizes
    near[at, own] = far[at, own] = np.inf
    nearest = near.argmin(1)
    other_near, other_far = near[at, nearest], far.min(1)
    # Where another cluster may be the nearest one to some rows of a cell, they are nearer than the mean says.
    gap = np.where(np.arange(near.shape[1]) == nearest[:, None], np.inf, near).min(1) - far[at, nearest]
    with np.errstate(divide="ignore", invalid="ignore"):
        loss = np.where(gap > 0, np.minimum(np.sqrt(variance), variance / gap), np.sqrt(variance))
        loss = np.where(gap >= 2 * radius, 0.0, loss)
        # Second derivatives of the score are at most 2 over the square of the greater distance.
        reach = np.maximum(own_near - slope * radius, other_near - radius)
        crossing = (own_near - slope * radius <= other_far + radius) & (other_near - radius <= own_far + slope * radius)
        bent = np.where(crossing, 3.0, 2.0) * slope**2 * variance / reach**2
        bent = np.where(variance == 0, 0.0, np.where(reach > 0, bent, np.inf))

    def score(a, b):
        top = np.maximum(a, b)
        return np.where(top == 0, 0.0, (b - a) / np.where(top == 0, 1.0, top))

    # The score falls with the distance to the own cluster and rises with that to the nearest other.
    with np.errstate(invalid="ignore"):
        low = np.maximum(score(own_far, np.maximum(other_near - loss, 0.0)) - bent, -1.0)
        high = np.minimum(score(own_near, other_far) + bent, 1.0)
    return np.where(alone, 0.0, low), np.where(alone, 0.0, high)
