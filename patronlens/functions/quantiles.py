"""Exact order statistics and interpolated quantiles for any number of rows.

Quantiles of numbers: a mergeable sketch brackets every wanted rank, the next reading counts
exactly below and inside the bracket and sketches the inside, until a sketch holds all that
is left.  Two readings do for a million different values, four for 10 ** 12.

Order statistics of values of any type: values are counted, the counted values are written in
range order with the number of their range, and the ranges' totals tell in which one a wanted
rank lies.  Only there do running totals rank the values.  Ties are counted before they
are ranked, so a value that a third of all rows share is one row, and no task holds more
than one range of different values.

The driver sees one row per range and a few values per rank, never a row of the input.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from patronlens.sources.stages import stage

#: Values that a sketch holds before it starts to thin them out, and the share of ranks it may then be off by.
SKETCH_SIZE = 4096
SKETCH_ERROR = 0.002
#: Tasks that merge sketches before the last one.
MERGE_SLOTS = 64
_SLOT = "__slot"


@dataclass
class Target:
    """Wanted ranks (0-based) among the values of the rows that satisfy ``where``."""

    where: Column
    ranks: Sequence[int]


def order_statistics(df: DataFrame, value: str, targets: Sequence[Target]) -> list[dict[int, object]]:
    """For each target, the exact value at each of its ranks."""
    ranges = _in_ranges(df, [(t.where, F.col(value)) for t in targets])
    return _at_ranks(ranges, _totals(ranges), {i: sorted(set(t.ranks)) for i, t in enumerate(targets)})


def exact_quantiles(df: DataFrame, probabilities: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of the named columns, NULL and NaN left out.

    ``{"Monetary": [0.25, 0.5]}`` gives ``{"Monetary": [q25, q50]}``.  Every reading of ``df`` is one
    aggregate of counts and sketches, combined on the map side; values are neither shuffled nor collected.
    """
    columns = list(probabilities)
    values = df.select(F.pmod(F.spark_partition_id(), F.lit(MERGE_SLOTS)).alias(_SLOT), *[_number(c).alias(c) for c in columns])
    asked = _aggregated(values, {str(i): (F.col(f"`{c}`"), {"n": F.count(f"`{c}`")}) for i, c in enumerate(columns)})
    positions: dict[str, list[float]] = {}
    searches: list[_Search] = []
    for i, c in enumerate(columns):
        n = asked[f"n_{i}"]
        positions[c] = [(n - 1) * p for p in probabilities[c]] if n else []
        for ranks in sorted({(math.floor(p), math.ceil(p)) for p in positions[c]}):
            searches.append(_Search(c, sorted(set(ranks)), 0, n, asked[f"sketch_{i}"]))
    found = _narrowed(values, searches)

    def between(column: str, position: float) -> float:
        low, high = found[column, math.floor(position)], found[column, math.ceil(position)]
        if low == high:
            return low
        rest = math.floor(position)
        return (math.ceil(position) - position) * low + (position - rest) * high

    return {c: [between(c, p) for p in positions[c]] or [None] * len(probabilities[c]) for c in columns}


@dataclass
class _Search:
    """Neighbouring ranks of a column's values, known to lie among ``inside`` of them that follow ``below`` others."""

    column: str
    ranks: list[int]
    below: int
    inside: int
    sketch: bytes


def _aggregated(values: DataFrame, wanted: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> Row:
    """One row of counts and sketches; a few slots merge the tasks' sketches before one task merges the slots'."""
    first, last = [], []
    for name, (sketched, counts) in wanted.items():
        first.append(F.kll_sketch_agg_double(sketched, SKETCH_SIZE).alias(f"sketch_{name}"))
        last.append(F.kll_merge_agg_double(f"sketch_{name}", SKETCH_SIZE).alias(f"sketch_{name}"))
        for count, column in counts.items():
            first.append(column.alias(f"{count}_{name}"))
            last.append(F.coalesce(F.sum(f"{count}_{name}"), F.lit(0)).alias(f"{count}_{name}"))
    return values.groupBy(_SLOT).agg(*first).agg(*last).first()


def _narrowed(values: DataFrame, searches: Sequence[_Search]) -> dict[tuple[str, int], float]:
    """The value at each rank.

    A sketch of at most ``SKETCH_SIZE`` values holds them all and gives the value itself.  A larger
    one gives two values around the ranks; the next reading counts what lies below, at and between
    them, and sketches what lies between.  A wrong guess of the sketch only widens the next search,
    and each reading takes at least the two values out, so ties of any size come to an end.
    """
    found: dict[tuple[str, int], float] = {}
    slack = SKETCH_ERROR
    while searches:
        asked: list[tuple[bytes, float]] = []
        for s in searches:
            exact = s.inside <= SKETCH_SIZE
            places = [r - s.below + 0.5 for r in s.ranks] if exact else [
                s.ranks[0] - s.below - slack * s.inside, s.ranks[-1] - s.below + 1 + slack * s.inside
            ]
            asked += [(bytes(s.sketch), min(max(place / s.inside, 0.0), 1.0)) for place in places]
        answers = iter(_sketch_quantiles(values.sparkSession, asked))
        brackets: list[tuple[_Search, float, float]] = []
        for s in searches:
            if s.inside <= SKETCH_SIZE:
                found.update({(s.column, r): next(answers) for r in s.ranks})
            else:
                brackets.append((s, next(answers), next(answers)))
        if not brackets:
            break
        wanted = {}
        for i, (s, low, high) in enumerate(brackets):
            v = F.col(f"`{s.column}`")
            within = F.when((v > low) & (v < high), v)
            counts = {
                "below": F.count_if(v < low), "low": F.count_if(v == low), "inside": F.count(within),
                "high": F.count_if((v == high) & (v > low)),
            }
            wanted[str(i)] = (within, counts)
        row = _aggregated(values, wanted)
        searches, missed = [], False
        for i, (s, low, high) in enumerate(brackets):
            start = row[f"below_{i}"]
            after_low = start + row[f"low_{i}"]
            after_inside = after_low + row[f"inside_{i}"]
            after_high = after_inside + row[f"high_{i}"]
            within = [r for r in s.ranks if after_low <= r < after_inside]
            outside = [r for r in s.ranks if not start <= r < after_high]
            found.update({(s.column, r): low for r in s.ranks if start <= r < after_low})
            found.update({(s.column, r): high for r in s.ranks if after_inside <= r < after_high})
            if within:
                searches.append(_Search(s.column, within, after_low, row[f"inside_{i}"], row[f"sketch_{i}"]))
            if outside:
                searches.append(_Search(s.column, outside, s.below, s.inside, s.sketch))
                missed = True
        slack = min(max(slack * 4, 0.001), 1.0) if missed else SKETCH_ERROR
    return found


def _sketch_quantiles(spark: SparkSession, asked: Sequence[tuple[bytes, float]]) -> list[float]:
    columns = [F.kll_sketch_get_quantile_double(F.lit(sketch), F.lit(share)).alias(f"value_{i}") for i, (sketch, share) in enumerate(asked)]
    return list(spark.range(1).select(*columns).first())


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _in_ranges(df: DataFrame, series: Sequence[tuple[Column, Column]]) -> DataFrame:
    """``series, value, n, range``: counted values, written in the order of series and value."""
    entries = [
        F.when(where & value.isNotNull(), F.struct(F.lit(i).alias("series"), value.alias("value")))
        for i, (where, value) in enumerate(series)
    ]
    wanted = reduce(or_, [where & value.isNotNull() for where, value in series])
    listed = df.where(wanted).select(F.inline(F.array_compact(F.array(*entries))))
    counted = listed.groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.repartitionByRange("series", "value")
    return stage(ordered.withColumn("range", F.spark_partition_id()), "counted-values")


def _totals(ranges: DataFrame) -> list[tuple[int, int, int]]:
    rows = ranges.groupBy("series", "range").agg(F.sum("n").alias("n")).collect()
    return sorted((r["series"], r["range"], r["n"]) for r in rows)


def _at_ranks(
    ranges: DataFrame, totals: Sequence[tuple[int, int, int]], wanted: Mapping[int, Sequence[int]]
) -> list[dict[int, object]]:
    before: dict[int, int] = {}
    places: list[tuple[int, int, int, list[int]]] = []
    for series, number, n in totals:
        start = before.get(series, 0)
        here = [r for r in wanted.get(series, ()) if start <= r < start + n]
        if here:
            places.append((series, number, start, here))
        before[series] = start + n
    found: list[dict[int, object]] = [{} for _ in range(max(wanted, default=-1) + 1)]
    if not places:
        return found
    ranks = F.when(F.lit(False), F.array().cast("array<long>"))
    start = F.when(F.lit(False), F.lit(0))
    for series, number, first, here in places:
        in_place = (F.col("series") == series) & (F.col("range") == number)
        ranks = ranks.when(in_place, F.array(*[F.lit(r).cast("long") for r in here]))
        start = start.when(in_place, F.lit(first))
    held = ranges.withColumn("ranks", ranks).where(F.col("ranks").isNotNull())
    running = Window.partitionBy("series", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumn("up_to", start + F.sum("n").over(running))
    hit = F.filter("ranks", lambda r: (r < F.col("up_to")) & (r >= F.col("up_to") - F.col("n")))
    for row in placed.select("series", "value", F.explode(hit).alias("rank")).collect():
        found[row["series"]][row["rank"]] = row["value"]
    return found
