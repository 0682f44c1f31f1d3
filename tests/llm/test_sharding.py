from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patronlens.llm import sharding
from patronlens.llm.sharding import assign_shards, number_slots, shard_table, write_shards


def drawn(key, weights):
    def score(s):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -weights[s] / math.log(u)

    return max(range(len(weights)), key=lambda s: (score(s), -s))


def test_equals_the_definition(spark):
    weights = [1.0, 2.5, 0.5, 1.0]
    found = assign_shards(spark.range(500).withColumnRenamed("id", "doc_id"), weights, more=[3.0]).collect()
    assert all(r["shard"] == drawn(r["doc_id"], weights) for r in found)
    assert all(r["grown_shard"] == drawn(r["doc_id"], [*weights, 3.0]) for r in found)


def test_shares_follow_weights_and_few_records_move(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = assign_shards(rows, [1.0, 3.0, 1.0, 1.0], more=[2.0])
    shares = {r["shard"]: r["count"] / 20_000 for r in before.groupBy("shard").count().collect()}
    assert shares == pytest.approx({0: 1 / 6, 1: 1 / 2, 2: 1 / 6, 3: 1 / 6}, abs=0.015)
    moved = before.where("shard <> grown_shard")
    assert {r[0] for r in moved.select("grown_shard").distinct().collect()} == {4}
    assert moved.count() / 20_000 == pytest.approx(1 / 4, abs=0.015)
    heavier = assign_shards(rows, [1.0, 4.0, 1.0, 1.0]).withColumnRenamed("shard", "after")
    changed = before.join(heavier, "doc_id").where("shard <> after")
    assert {r[0] for r in changed.select("after").distinct().collect()} == {1}


def test_edge_rows(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    texts = [(1, None), (1, ""), (None, "a"), (None, None), (2, "ü" * 100_000)] + [(3, "same")] * 37 + [(4, "x")] * 10
    docs = make_docs(texts).withColumns({"shard": F.lit("theirs"), "slot": F.lit(9), "size": F.lit("s")})
    found = shard_table(docs, [1.0, 1.0, 1.0], more=[1.0]).collect()
    assert len(found) == len(texts)
    expected = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    assert all(r["shard"] == drawn("" if r["doc_id"] is None else r["doc_id"], [1.0] * 3) for r in found)
    for shard in range(3):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert shard_table(make_docs([]), [1.0]).collect() == []
    with pytest.raises(ValueError, match="weights"):
        assign_shards(docs, [1.0, 0.0])


def test_slots_do_not_depend_on_partitions(spark):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("doc_id"), (F.col("id") % 3).cast("int").alias("shard"))
    one = sorted(number_slots(rows.coalesce(1)).collect())
    assert sorted(number_slots(rows.repartition(13)).collect()) == one


def test_no_python_in_the_plan(spark, make_docs):
    plan = shard_table(make_docs([(1, "a")]), [1.0] * 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards_hold_every_row(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"text {i}") for i in range(300)] + [(7, "again")] * 3)
    write_shards(docs, str(tmp_path / "out"), [1.0, 2.0, 1.0], parts=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 303
    assert all(r["shard"] == drawn(r["doc_id"], [1.0, 2.0, 1.0]) for r in back.collect())
    assert len(list((tmp_path / "out" / "shard=1").glob("*.parquet"))) <= 4
