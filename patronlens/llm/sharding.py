"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every shard draws a number u in (0, 1) for a key, from the MD5 of ``<key>:<shard>``, and
the key goes to the shard with the largest ``-weight / ln(u)``; of equal ones, to the first.
A shard's share is its part of all weights.  No shard's draw depends on the others, so one
more shard takes keys only into itself, and a changed weight moves keys only to or from
its own shard.  Nothing is shuffled to assign shards.

Slots number the rows of a shard without gaps.  Their order is that of the MD5 of key,
size and checksum: a fixed shuffle of the shard.  Equal rows are counted before they are
sorted and laid out again afterwards, the large counts in blocks, and a shard is numbered
by 4,096 ranges of that order, so neither a hot key nor a group of copies fills a task.

Null keys count as the empty key; null texts have no bytes.  Rows that are equal in key, size
and checksum are all kept, each with a slot of its own.  A key may be any castable type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.sources.stages import stage

LAW = "key"
HEADER_BYTES = 8
# Equal rows are laid out in blocks of so many.
BLOCK_ROWS = 100_000
# 13 hexadecimal digits are 52 bits, exact in a double; 3 of them part the order into 4,096 ranges.
_DRAW_DIGITS, _RANGE_DIGITS = 13, 3


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, _DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**_DRAW_DIGITS))
    return -weight / F.ln(u)


def draws(key: Column, weights: Sequence[float]) -> Column:
    """For each shard in turn a struct of its score and its number, negated so that the first wins ties."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("shards need weights above zero")
    text = F.coalesce(key.cast("string"), F.lit(""))
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.transform(
        shards, lambda s: F.struct(_draw(text, s["i"], s["w"]).alias("score"), (-s["i"]).alias("minus"))
    )


def assign_shards(
    rows: DataFrame, weights: Sequence[float], *, key: str = "doc_id", more: Sequence[float] = ()
) -> DataFrame:
    """All rows with ``shard``, and with ``grown_shard``: the shard once those of ``more`` have joined.

    Without ``more``, ``grown_shard`` is null.  Input columns of these two names are replaced.
    """
    base = rows.drop("shard", "grown_shard")
    drawn = base.withColumn("drawn ", draws(F.col(key), [*weights, *more]))
    first = -F.array_max(F.slice("drawn ", 1, len(weights)))["minus"]
    grown = -F.array_max("drawn ")["minus"] if more else F.lit(None).cast("int")
    return drawn.withColumns({"shard": first, "grown_shard": grown}).drop("drawn ")


def number_slots(rows: DataFrame, shard: str = "shard", order: Sequence[str] = ()) -> DataFrame:
    """All rows with ``slot``, from 0 without gaps in each shard; rows should be narrow, for they are sorted.

    The order is that of the MD5 of the columns in ``order`` (all but the shard, if none are
    given), then of all columns.  Rows equal in every column are interchangeable.  An input column ``slot``
    is replaced.
    """
    rows = rows.drop("slot")
    names = rows.columns
    mark = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order or names if c != shard]))
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies ")).withColumn("mark ", mark)
    counted = stage(counted.withColumn("range ", F.substring("mark ", 1, _RANGE_DIGITS)), "slots")
    before = Window.partitionBy(shard).orderBy("range ").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        counted.groupBy(shard, "range ").agg(F.sum("copies ").alias("held "))
        .select(F.col(shard).alias("shard "), F.col("range ").alias("of "), F.coalesce(F.sum("held ").over(before), F.lit(0)).alias("offset "))
    )
    inside = Window.partitionBy(shard, "range ").orderBy("mark ", *names).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto ", F.sum("copies ").over(inside)).join(
        ranges, F.col(shard).eqNullSafe(F.col("shard ")) & (F.col("range ") == F.col("of "))
    )
    placed = placed.select(*names, "copies ", (F.col("offset ") + F.col("upto ") - F.col("copies ")).alias("start "))
    placed = stage(placed, "slots")

    def slots(start: Column, count: Column) -> Column:
        return F.explode(F.sequence(start, start + count - 1)).alias("slot")

    few = placed.where(F.col("copies ") <= BLOCK_ROWS).select(*names, slots(F.col("start "), F.col("copies ")))
    blocks = placed.where(F.col("copies ") > BLOCK_ROWS).withColumn(
        "block ", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies ") - 1, F.lit(BLOCK_ROWS).cast("long")))
    )
    size = F.least(F.lit(BLOCK_ROWS), F.col("copies ") - F.col("block "))
    many = blocks.repartition("start ", "block ").select(*names, slots(F.col("start ") + F.col("block "), size))
    return few.unionByName(many)


def shard_table(
    docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", more: Sequence[float] = ()
) -> DataFrame:
    """Per row: ``key``, size (bytes of its text and 8), text_crc32, law, shard, slot, grown_shard."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col(key), (F.octet_length(data) + HEADER_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    placed = number_slots(assign_shards(narrow, weights, key=key, more=more), order=[key, "size", "text_crc32"])
    return placed.select(key, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def write_shards(rows: DataFrame, path: str, weights: Sequence[float], *, key: str = "doc_id", parts: int = 16) -> None:
    """Write all rows below ``path``, one folder ``shard=<n>`` a shard with up to ``parts`` files each.

    Rows of one key and shard are dealt over the files by all their columns.
    """
    placed = assign_shards(rows, weights, key=key).drop("grown_shard")
    part = F.pmod(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rows.columns]), F.lit(parts))
    placed.withColumn("part ", part).repartition("shard", "part ").drop("part ").write.partitionBy("shard").parquet(path)
