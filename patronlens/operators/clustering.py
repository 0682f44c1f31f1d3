"""K-means over the scaled features: fitting, the sweep over k, and the choice of k."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Row, functions as F

from patronlens.operators.features import FEATURES
from patronlens.operators.shaping import dimension
from patronlens.operators.silhouette import cluster_facts, plain_silhouette, silhouette

FIRST_SEED = 42
RESTARTS = 10
#: Rows among which first centers are drawn.
SEEDING_ROWS = 4000
K_RANGE = range(2, 11)
#: Rows near a border between clusters, over all fits, that a reading is to hand to the driver; it never hands on twice as many.
NEAR_ROWS = 1 << 20
# Different rows a task is to read at most; rows packed together, taken together if one center is the nearest
# to all of them, and whose distances are computed at a time.
_TASK_ROWS, _BLOCK, _GROUP, _PART = 1_000_000, 1 << 16, 64, 8192


@dataclass(frozen=True)
class Centers:
    """Cluster centers in feature space; the cluster id is the position in the list."""

    points: Sequence[Sequence[float]]
    cost: float | None = None

    @property
    def k(self) -> int:
        return len(self.points)

    def assign(self, features: DataFrame, cost: str | None = None) -> DataFrame:
        """Adds Cluster, the nearest center, and on request the squared distance to it.

        Plain arithmetic on literals, so it stays inside generated code: every
        distance is a column, the cost is the least of them, and the first center
        at that cost is the cluster.
        """
        numbers = range(self.k)
        distances = [f"{self._squared_distance(i)} AS __distance_{i}" for i in numbers]
        least = f"least({', '.join(f'__distance_{i}' for i in numbers)})" if self.k > 1 else "__distance_0"
        cases = [f"WHEN __distance_{i} = __cost THEN {i}" for i in numbers]
        assigned = (
            features.selectExpr("*", *distances)
            .selectExpr("*", f"{least} AS __cost")
            .selectExpr("*", f"CASE {' '.join(cases)} END AS Cluster")
        )
        return assigned.select(
            *features.columns, "Cluster", *([F.col("__cost").alias(cost)] if cost else [])
        )

    def _squared_distance(self, number: int) -> str:
        point = map(float, self.points[number])
        return " + ".join(f"(`{c}` - {x!r}D) * (`{c}` - {x!r}D)" for c, x in zip(FEATURES, point))

    def reordered(self, order: Sequence[int]) -> Centers:
        return Centers([self.points[i] for i in order], self.cost)


def fit_kmeans(
    features: DataFrame,
    ks: Iterable[int],
    *,
    restarts: int = RESTARTS,
    seed: int = FIRST_SEED,
    max_iter: int = 300,
    relative_tol: float = 1e-4,
    seeding_rows: int = SEEDING_ROWS,
) -> dict[int, Centers]:
    """The cheapest of ``restarts`` fits for every k.

    All fits share each reading of the rows, in which a task adds up its rows for every center of every open
    fit.  A reading serves many iterations: a row whose second nearest center is farther than its nearest by more
    than any two centers have moved since keeps its center, so only the sums of such rows are handed on, and the
    rows nearest to a border, about ``NEAR_ROWS`` over all fits, reach the driver and are assigned there in every
    iteration.  When centers have moved too far for that, the rows are read again.  Assignments are those of plain
    iterations over all rows.  A fit leaves
    when the squared moves of its centers sum to at most ``relative_tol`` times the mean variance
    of the features; what a sum differs by when tasks end in another order counts as no move.
    Equal rows are counted first and read as one from then on, so a reading costs what the different
    ones cost.  These are kept packed in memory (on disk where memory is short); a lost block is counted again
    from the stage table below.

    First centers are drawn with chances proportional to squared distances from those drawn before,
    among the ``seeding_rows`` different rows with the smallest hashes, and moved to rest among these.
    Restarts that come to rest at the same centers go on as one.
    """
    ks = sorted(set(ks))
    all_rows = features.select(*[F.col(c).cast("double").alias(c) for c in FEATURES])
    row = all_rows.agg(reduce(add, [F.var_pop(c) for c in FEATURES]).alias("variance"), F.count(F.lit(1)).alias("rows")).first()
    if not row["rows"]:
        raise ValueError("no rows to fit centers to")
    bound = max(relative_tol, 1e-20) * row["variance"] / len(FEATURES)
    tasks = max(features.sparkSession.sparkContext.defaultParallelism, -(-row["rows"] // _TASK_ROWS))
    rows = all_rows.groupBy(*FEATURES).agg(F.count(F.lit(1)).cast("double").alias("copies")).repartition(tasks, *FEATURES)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    packed = _packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        different = rows.count()
        sample = _seeding_sample(rows, seeding_rows)
        packed.count()
        rows.unpersist()
        drawn = {(k, seed + i): _first_centers(sample, k, seed + i) for k in ks for i in range(restarts)}
        first = {_in_order(points): name for name, points in reversed(drawn.items())}
        fits = {name: points for name, points in drawn.items() if first[_in_order(points)] == name}
        costs, left = {}, dict.fromkeys(fits, max_iter)
        open_fits = list(fits)
        while open_fits:
            share = NEAR_ROWS / len(open_fits) / different
            limits = [_gap_limit(sample, fits[f], share) for f in open_fits]
            readings = _read(packed, [fits[f] for f in open_fits], limits, 2 * NEAR_ROWS // (len(open_fits) * tasks))
            still = []
            for name, reading in zip(open_fits, readings):
                fits[name], costs[name], steps, settled = _advanced(reading, bound, left[name])
                left[name] -= steps
                if left[name] and not settled:
                    still.append(name)
            open_fits = still
    finally:
        rows.unpersist()
        packed.unpersist()
    best: dict[int, Centers] = {}
    for (k, start), points in fits.items():
        cost = costs[k, start]
        if k not in best or cost < best[k].cost:
            best[k] = Centers(points.tolist(), cost)
    return best


def _seeding_sample(rows: DataFrame, size: int) -> np.ndarray:
    """Of different rows those with the smallest hashes, at most ``size``: the same ones for any partitioning."""
    smallest = rows.withColumn("draw", F.xxhash64(*FEATURES)).orderBy("draw", *FEATURES).limit(size)
    return np.array([[r[c] for c in FEATURES] for r in smallest.collect()], float)


def _first_centers(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng([seed, k])
    points = [sample[draw.integers(len(sample))]]
    distance = ((sample - points[0]) ** 2).sum(1)
    while len(points) < k:
        total = distance.sum()
        points.append(sample[draw.choice(len(sample), p=distance / total) if total else draw.integers(len(sample))])
        distance = np.minimum(distance, ((sample - points[-1]) ** 2).sum(1))
    return _settled(sample, np.array(points))


def _settled(sample: np.ndarray, points: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Centers moved to their members' means within the sample, so that few readings of all rows are left."""
    squares = (sample * sample).sum(1)
    for _ in range(rounds):
        distances = squares[:, None] - 2.0 * (sample @ points.T) + (points * points).sum(1)
        own = distances.argmin(1)
        counts = np.bincount(own, minlength=len(points))
        held = counts > 0
        moved = points.copy()
        for c in range(sample.shape[1]):
            moved[held, c] = np.bincount(own, sample[:, c], minlength=len(points))[held] / counts[held]
        if np.array_equal(moved, points):
            break
        points = moved
    return points


def _in_order(points: np.ndarray) -> bytes:
    """The same for the same centers in any order."""
    return points[np.lexsort(points.T)].tobytes()


def _nearest(values: Sequence[np.ndarray], points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows given by columns: the nearest center, the squared distance to it, and that to the second nearest."""
    own = np.zeros(len(values[0]), np.intp)
    least, second = _squared(values, points[0]), np.full(len(values[0]), np.inf)
    for number, point in enumerate(points[1:], 1):
        distance = _squared(values, point)
        np.copyto(own, number, where=distance < least)
        np.minimum(second, np.maximum(distance, least), out=second)
        np.minimum(least, distance, out=least)
    return own, least, second


def _squared(values: Sequence[np.ndarray], point: np.ndarray) -> np.ndarray:
    total = None
    for value, x in zip(values, point):
        offset = value - x
        offset *= offset
        total = offset if total is None else np.add(total, offset, out=total)
    return total


def _gaps(least: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.sqrt(second) - np.sqrt(least)


def _gap_limit(sample: np.ndarray, points: np.ndarray, share: float) -> float:
    """About this share of the rows is nearer to a border: has a smaller gap between its two nearest centers."""
    if share >= 1:
        return math.inf
    _, least, second = _nearest(list(sample.T), points)
    return float(np.quantile(_gaps(least, second), share, method="higher"))


@dataclass(frozen=True)
class _Reading:
    """What a reading of all rows tells of a fit.

    ``totals``: for each center, rows, sums and cost of its members but the ``near`` rows, which come one by one with
    their number of copies.  The members' second nearest center is farther by ``reach`` at least.
    """

    points: np.ndarray
    totals: np.ndarray
    near: np.ndarray
    reach: float

    def holds(self, points: np.ndarray) -> bool:
        """Whether all members but the near rows certainly keep their center when the centers are ``points``."""
        moves = np.sort(np.sqrt(((points - self.points) ** 2).sum(1)))
        return float(moves[-2:].sum()) * (1 + 1e-9) < self.reach

    def sums(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows and sums of the members of the centers ``points``, and their cost."""
        totals, moved = self.totals.copy(), points - self.points
        around = totals[:, 1:-1] - totals[:, :1] * self.points
        totals[:, -1] += totals[:, 0] * (moved**2).sum(1) - 2 * (moved * around).sum(1)
        *values, times = self.near.T
        if len(times):
            own, least, _ = _nearest(values, points)
            _add_up(totals, own, times, [*(value * times for value in values), least * times])
        return totals[:, 0], totals[:, 1:-1], float(totals[:, -1].sum())


def _add_up(totals: np.ndarray, own: np.ndarray, times: np.ndarray, weighted: Sequence[np.ndarray]) -> None:
    for column, value in enumerate([times, *weighted]):
        totals[:, column] += np.bincount(own, value, minlength=len(totals))


def _advanced(reading: _Reading, bound: float, most: int) -> tuple[np.ndarray, float, int, bool]:
    """Iterations of a fit as far as its reading holds, at most ``most``: centers, cost before the last move, iterations, whether it has settled."""
    points, steps = reading.points, 0
    while True:
        counts, sums, cost = reading.sums(points)
        held = counts > 0
        moved = points.copy()
        moved[held] = sums[held] / counts[held, None]
        settled = not float(((moved - points) ** 2).sum()) > bound
        points, steps = moved, steps + 1
        if settled or steps >= most or not reading.holds(points):
            return points, cost, steps, settled


def _lloyd_sums(rows: DataFrame, fits: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each fit: rows and sums of its centers' members, and its cost."""
    return [r.sums(r.points) for r in _read(_packed(rows), fits, [-1.0] * len(fits), 0)]


def _packed(rows: DataFrame) -> DataFrame:
    """Different rows with their number of ``copies`` as blocks of numbers, column after column, neighbours of a task's rows together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns]) for batch in batches]
        whole = np.concatenate([np.zeros((len(FEATURES) + 1, 0)), *parts], 1)
        del parts
        whole = whole[:, _along_curve(whole[:-1])]
        for at in range(0, whole.shape[1], _BLOCK):
            block = whole[:, at: at + _BLOCK].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    return rows.select(*FEATURES, "copies").mapInArrow(pack, "block binary")


def _along_curve(values: np.ndarray, bits: int = 10) -> np.ndarray:
    """An order of rows in which neighbours are close: along a Z curve through the ranks of their features."""
    code = np.zeros(values.shape[1], np.int64)
    for c, value in enumerate(values):
        rank = np.searchsorted(np.sort(value), value) * (1 << bits) // max(len(value), 1)
        for bit in range(bits):
            code |= (rank >> bit & 1) << (bit * len(values) + c)
    return np.argsort(code, kind="stable")


class _Groups:
    """Rows of a block by groups of neighbours: a group's middle and radius, copies, weighted sums, and squared offsets from the middle."""

    def __init__(self, values: Sequence[np.ndarray], copies: np.ndarray) -> None:
        starts = np.arange(0, len(copies), _GROUP)
        sides = [(np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)) for v in values]
        self.middle = [(low + high) / 2 for low, high in sides]
        self.radius = np.sqrt(sum(((high - low) / 2) ** 2 for low, high in sides))
        self.times = np.add.reduceat(copies, starts)
        self.sums = [np.add.reduceat(v * copies, starts) for v in values]
        around = sum((v - np.repeat(m, _GROUP)[: len(v)]) ** 2 for v, m in zip(values, self.middle))
        self.squares = np.add.reduceat(around * copies, starts)

    def add_up(self, totals: np.ndarray, points: np.ndarray, limit: float) -> np.ndarray:
        """Adds the groups all of whose rows have the same nearest center, with a gap above ``limit``; the places of the other rows."""
        own, least, second = _nearest(self.middle, points)
        slack = 1e-9 * (1 + np.sqrt(least))
        whole = _gaps(least, second) - 2 * self.radius > max(limit, 0.0) + slack
        at, times = own[whole], self.times[whole]
        cost, sums = self.squares[whole] + times * least[whole], []
        for c, middle in enumerate(self.middle):
            sums.append(self.sums[c][whole])
            cost += 2 * (middle[whole] - points[at, c]) * (sums[c] - times * middle[whole])
        _add_up(totals, at, times, [*sums, cost])
        return np.flatnonzero(np.repeat(~whole, _GROUP))


def _read(packed: DataFrame, fits: Sequence[np.ndarray], limits: Sequence[float], most: int) -> list[_Reading]:
    """One reading for all fits.  One row a center leaves a task, with ``most`` near rows a fit at most.

    Rows count as near if the gap between
    their two nearest centers is at most the fit's limit; where a task has too many it keeps those with the smallest gaps.
    """
    starts = np.cumsum([0, *map(len, fits)])
    points = np.concatenate(fits)
    width = len(FEATURES)
    names = ["place", "n", *FEATURES, "cost", "reach", "near"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(points), width + 2))
        reach = list(limits)
        # Of each fit's near rows: gap, features, copies, center, squared distance.
        near = [np.zeros((0, width + 4)) for _ in fits]

        def trim(number: int) -> None:
            kept = near[number]
            if len(kept) > most:
                order = np.argsort(kept[:, 0], kind="stable")
                near[number], rest = kept[order[:most]], kept[order[most:]]
                reach[number] = float(rest[0, 0])
                times = rest[:, width + 1]
                weighted = [*(rest[:, 1 + c] * times for c in range(width)), rest[:, -1] * times]
                _add_up(totals[starts[number]: starts[number + 1]], rest[:, -2].astype(np.intp), times, weighted)

        for batch in batches:
            for block in batch.column(0):
                *columns, copies = np.frombuffer(block.as_buffer()).reshape(width + 1, -1)
                groups = _Groups(columns, copies)
                for number, (begin, end) in enumerate(zip(starts[:-1], starts[1:])):
                    places = groups.add_up(totals[begin:end], points[begin:end], reach[number])
                    places = places[: np.searchsorted(places, len(copies))]
                    for at in range(0, len(places), _PART):
                        part = places[at: at + _PART]
                        values, times = [column[part] for column in columns], copies[part]
                        own, least, second = _nearest(values, points[begin:end])
                        if reach[number] >= 0:
                            gaps = _gaps(least, second)
                            close = np.flatnonzero(gaps <= reach[number])
                            if len(close):
                                more = np.stack([x[close] for x in (gaps, *values, times, own, least)], 1)
                                near[number] = np.concatenate([near[number], more])
                                if len(near[number]) > 4 * most + _PART:
                                    trim(number)
                                times[close] = 0
                        _add_up(totals[begin:end], own, times, [*(value * times for value in values), least * times])
        for number in range(len(fits)):
            trim(number)
        sent = np.zeros(len(points), bool)
        sent[starts[:-1]] = True
        sent = np.flatnonzero(sent | (totals[:, 0] != 0))
        first = {place: number for number, place in enumerate(starts[:-1].tolist())}
        held = [near[first[place]][:, 1: width + 2].tobytes() if place in first else None for place in sent.tolist()]
        least = [reach[first[place]] if place in first else None for place in sent.tolist()]
        columns = [pa.array(sent, pa.int32()), *(pa.array(totals[sent, i]) for i in range(width + 2))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(least, pa.float64()), pa.array(held, pa.binary())], names)

    shape = "place int, " + ", ".join(f"`{name}` double" for name in names[1:-1]) + ", near binary"
    summed = packed.mapInArrow(read, shape).groupBy("place").agg(
        *[F.sum(name).alias(name) for name in names[1:-2]], F.min("reach").alias("reach"), F.collect_list("near").alias("near")
    )
    totals, told = np.zeros((len(points), width + 2)), {}
    for row in summed.collect():
        totals[row["place"]] = [row[name] for name in names[1:-2]]
        told[row["place"]] = row["reach"], row["near"]
    readings = []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        reach, parts = told[begin]
        near = np.frombuffer(b"".join(map(bytes, parts))).reshape(-1, width + 1)
        # In an order of their own, whatever task they come from.
        readings.append(_Reading(points[begin:end], totals[begin:end], np.asfortranarray(near[np.lexsort(near.T)]), reach))
    return readings


def measure(
    features: DataFrame, candidates: Mapping[int, Centers], *, metric: str = "squared", parallelism: int = 8
) -> DataFrame:
    """The sweep table (k, inertia, silhouette, metric); the metric of the silhouettes is squared or plain.

    Plain ones are the middle of an interval (see ``plain_silhouette``).

    Two passes per k, several k side by side.  One pass for all k at once would hold
    so many centers that its generated code grows past what the JVM compiles.
    """

    def one(k: int) -> tuple[int, float, float]:
        clustered = candidates[k].assign(features)
        facts = cluster_facts(clustered)
        score = silhouette(clustered, facts=facts) if metric == "squared" else plain_silhouette(clustered).score
        return k, _inertia(facts, candidates[k]), score

    if metric not in ("squared", "plain"):
        raise ValueError(f"no silhouette metric {metric!r}")

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(inheritable_thread_target(features.sparkSession)(one), sorted(candidates)))
    ks, inertias, scores = zip(*rows)
    sweep = dimension(features.sparkSession, k=list(ks), inertia=list(inertias), silhouette=list(scores))
    return sweep.withColumn("k", F.col("k").cast("int")).withColumn("metric", F.lit(metric))


def _inertia(facts: Sequence[Row], centers: Centers) -> float:
    """Squared distances to a center sum to rows * (variance + squared offset of the mean)."""
    total = 0.0
    for fact in facts:
        offsets = [fact[f"mean_{c}"] - x for c, x in zip(FEATURES, centers.points[fact["cluster"]])]
        total += fact["rows"] * (fact["variance"] + sum(o * o for o in offsets))
    return total


def best_k(sweep: DataFrame) -> DataFrame:
    """The k with the highest silhouette; the smallest wins a tie."""
    return sweep.orderBy(F.desc("silhouette"), "k").limit(1)


def business_k(sweep: DataFrame, tolerance: float = 0.8) -> DataFrame:
    """The largest k whose silhouette is at least ``tolerance`` times the best.

    With a negative best silhouette no k passes that bar; the best k is taken then.
    """
    top = sweep.agg(F.max("silhouette").alias("top")).scalar()
    good = sweep.where((F.col("silhouette") >= top * tolerance) | (F.col("silhouette") == top))
    passing = F.when(top >= 0, F.col("k"))
    return good.orderBy(passing.desc(), F.desc("silhouette"), "k").limit(1)


def by_mean_monetary(features: DataFrame, centers: Centers) -> Centers:
    """The same centers renumbered 0.. by falling mean spend, so ids no longer depend on chance."""
    means = centers.assign(features).groupBy("Cluster").agg(F.avg("Monetary").alias("mean")).collect()
    order = [r["Cluster"] for r in sorted(means, key=lambda r: (-r["mean"], r["Cluster"]))]
    unused = [i for i in range(centers.k) if i not in order]
    return centers.reordered(order + unused)


def fit_checks(
    features: DataFrame, fits: Mapping[int, Centers], rivals: Mapping[int, Centers], *, parallelism: int = 8
) -> DataFrame:
    """What any good fit satisfies, one row per k: all numbers but ``customers`` are 0 if it does.

    ``empty_clusters``: centers without customers; ``not_nearest``: customers nearer to
    another center than their own; ``off_mean``: centers away from their members' mean;
    ``dearer_than_rival``: whether the rival centers cost less; ``rising``: whether a
    smaller k costs less.  Several k are checked side by side.
    """

    def one(k: int) -> tuple[tuple[int, ...], float]:
        centers = fits[k]
        clustered = centers.assign(features, cost="own_cost")
        facts = cluster_facts(clustered)
        distances = [centers._squared_distance(i) for i in range(k)]
        nearer = F.array_min(F.array(*map(F.expr, distances))) < F.col("own_cost") * (1 - 1e-12)
        offsets = [
            max(abs(fact[f"mean_{c}"] - x) for c, x in zip(FEATURES, centers.points[fact["cluster"]])) for fact in facts
        ]
        cost = _inertia(facts, centers)
        rival = _inertia(cluster_facts(rivals[k].assign(features)), rivals[k])
        # Counted by an aggregate: a filter would be pushed below the assignment and repeat all its distances.
        not_nearest = clustered.agg(F.count_if(nearer)).first()[0]
        customers = sum(f["rows"] for f in facts)
        return (k, customers, k - len(facts), not_nearest, sum(o > 1e-3 for o in offsets), int(cost > rival)), cost

    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(features.sparkSession)(one), sorted(fits)))
    costs = [math.inf, *(cost for _, cost in found)]
    rows = [(*row, int(cost > before)) for (row, cost), before in zip(found, costs)]
    names = ["k", "customers", "empty_clusters", "not_nearest", "off_mean", "dearer_than_rival", "rising"]
    table = dimension(features.sparkSession, **{n: list(v) for n, v in zip(names, zip(*rows))})
    return table.withColumn("k", F.col("k").cast("int"))
