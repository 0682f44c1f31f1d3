from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from patronlens.llm import prefix_trie
from patronlens.llm.prefix_trie import DoubleArray, conversation_trie, numbered_turns, prefix_nodes, rebuilt_turns

SCHEMA = "conv_id long, turn long, role string, text string, key string, x long, depth long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


def brute(rows):
    def mark(turn):
        role, text = turn[2] or "", turn[3] or ""
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    turns = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, mark(r))):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = (*turns.get(c - c % 5, [])[:h], *own[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = set()
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in convs if rebuilt[c] == p)
        out.add((
            convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), len(children[p]),
            sum(not children[q] for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    assert len(out) == len(members)
    return out


def some_rows():
    pick = random.Random(5)
    rows = []
    for c in range(60):
        # Few words make shared prefixes of all lengths, and conversations that are prefixes of others.
        for t in range(pick.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, pick.choice(["user", "bot"]) if t > 3 else "user", pick.choice(["", "a", "über"]) if t > 1 else "a"))
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 180, 5) for t in range(11)]
    # Null turns first, null texts, turns that tie, repeated rows, ids below zero, rows without an id.
    rows += [(200, None, None, "x"), (200, None, "b", None), (200, 1, "b", "y"), (200, 1, "a", "z"), (200, 1, "a", "z")]
    rows += [(-7, 0, "user", "a"), (-7, 1, "user", "a"), (None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("cut, cells", [(256, 2_000_000), (256, 30), (3, 2_000_000), (2, 12)])
def test_nodes_equal_brute_force(spark, monkeypatch, cut, cells):
    monkeypatch.setattr(prefix_trie, "SHARD_CELLS", cells)
    rows = some_rows()
    bound = cells

    # The bound is read in the workers, so it travels inside the function there.
    shards = prefix_trie._shards

    def small(start):
        inner = shards(start)

        def nodes(batches):
            prefix_trie.SHARD_CELLS = bound
            return inner(batches)

        return nodes

    monkeypatch.setattr(prefix_trie, "_shards", small)
    found = prefix_nodes(*rebuilt_turns(numbered_turns(frame(spark, rows))), cut=cut).collect()
    assert len(found) == len(brute(rows))
    assert {tuple(r) for r in found} == brute(rows)


def test_conversations_without_turns_and_no_rows(spark):
    turnless = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(turnless, 0, "user", "only turn, replaced by a missing head")]
    assert {tuple(r) for r in conversation_trie(frame(spark, rows)).collect()} == brute(rows)
    assert conversation_trie(frame(spark, [])).collect() == []
    assert conversation_trie(frame(spark, [(None, 0, "user", "a")])).collect() == []


def test_hot_conversation_is_numbered_in_ranges(spark):
    rows = [(5, t, "user", str(t)) for t in range(3000)] + [(c, 0, "user", "a") for c in range(10, 400)]
    found = numbered_turns(frame(spark, rows).repartition(7))
    assert found.where("conv_id = 5").selectExpr("count(distinct pos)", "max(pos)").first()[:] == (3000, 2999)
    assert found.where("conv_id <> 5 and pos <> 0").count() == 0


def test_double_array_holds_all_rows_and_no_others():
    rng = np.random.default_rng(3)
    rows = sorted({tuple(rng.integers(0, 9, rng.integers(1, 7))) for _ in range(400)})
    symbols = np.full((len(rows), 6), -1, np.int64)
    for i, r in enumerate(rows):
        symbols[i, : len(r)] = r
    trie = DoubleArray.of(symbols)
    prefixes = {r[:d] for r in rows for d in range(1, len(r) + 1)}
    slots = trie.walk(symbols)
    seen = {rows[i][: d + 1]: slots[i, d] for i in range(len(rows)) for d in range(len(rows[i]))}
    assert len(set(seen.values())) == len(prefixes)
    others = np.array([(*p, s) + (-1,) * (5 - len(p)) for p in prefixes if len(p) < 6 for s in range(9) if (*p, s) not in prefixes])
    walked = trie.walk(others)
    assert all(walked[i, (o >= 0).sum() - 1] == -1 for i, o in enumerate(others))
