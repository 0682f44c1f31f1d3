"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronlens.sources.stages import released, stage

ROWS_PER_TASK = 250_000


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (a long, b long).

    Alternating rounds: every node hands its smallest neighbour to its larger neighbours,
    then to its smaller ones, until each component is a star around its smallest node.
    The number of rounds grows with the logarithm of the longest path.  Each round is
    written to a stage table, so no lineage builds up and no link reaches the driver.
    Rounds run in as many tasks as their rows call for; their tables go when the result is written.
    """
    with released() as keep:
        return keep(_components(links), "components")


def _components(links: DataFrame) -> DataFrame:
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")).first()
        if now == before:
            break
        before, tasks = now, max(now["n"] // ROWS_PER_TASK, 8)
        # Large star: neighbours above a node are linked to the smallest one around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = stage(large.coalesce(tasks), "links")
        # Small star: a node and its neighbours below are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        own = least.select("a", F.col("least").alias("b"))
        edges = stage(small.unionByName(own).coalesce(tasks).distinct().coalesce(tasks), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
