"""The trie of all prefixes of conversations, by double arrays.

Turns are numbered, conversations rebuilt (see ``rebuilt_turns``) and equal ones counted
as one sequence; all this works on rows of turns.  Sequences are then dealt to shards by ranges
of their order, so a shard is a run of neighbours, and however many sequences share a prefix, they
spread over the shards.  A shard numbers its turns densely and packs its trie into two arrays: a child by turn
id t of the node in slot s stands in slot BASE[s] + t, whose CHECK is s.  All sequences walk
down these arrays at once; counts go up them from the deepest level.  Only nodes on the first and the last
path of a shard can occur in other shards: these are merged in Spark, and their sums are
made up from what the shards hold below them.

Trees deeper than CUT turns are cut into levels of CUT turns; a level's totals are handed to
the nodes that it hangs on.  So a row holds at most CUT turn ids, however long a conversation is.

A turn is known by 128 bits of the SHA-256 of role and text, a prefix by 128 bits over its turns.  Null
roles and texts count as empty.  Turns that tie in ``turn`` are ordered by that SHA-256, repeated rows
are turns of their own.  Rows without a conv_id belong to no conversation.  An empty table has no
nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.functions.running import running_totals
from patronlens.sources.stages import stage

GROUP = 5
SHARE_MODULUS = 9
CUT = 256
# Conversation ids are joined in blocks of so many possible ids.
ID_BLOCK = 65_536
# A shard's arrays are built for so many sequence places at a time.
SHARD_CELLS = 2_000_000
# Slots tried for the children of a node before they go to the end.
TRIES = 32
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``key`` (16 bytes) and ``size`` (bytes of the text) of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.substring(F.unhex(mark), 1, 16).alias("key"), F.octet_length(text).cast("long").alias("size")
    )
    placed = running_totals(turns, ["conv_id", "turn", "key"], F.lit(1), "pos", within=["conv_id"])
    return placed.select("conv_id", "pos", "key", "size")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth`` (from 1), ``key, size`` of rebuilt conversations, and all their ids.

    Conversation c takes the first h turns of c - c % GROUP (all if there are fewer, none if it is
    missing), then its own turns after its first h; h is the CRC-32 of c in decimal, modulo SHARE_MODULUS.
    """
    turns = stage(turns, "turns")
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % SHARE_MODULUS
    conversations = stage(turns.select("conv_id").distinct(), "conversations")
    heads = F.col("conv_id") % GROUP == 0
    first = turns.where(heads & (F.col("pos") < SHARE_MODULUS - 1)).withColumnRenamed("conv_id", "head")
    known = first.groupBy("head").agg(F.count(F.lit(1)).alias("known"))
    others = turns.where(~heads & (F.col("pos") >= h)).withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP)
    own = others.join(known, "head", "left").select(
        "conv_id", (F.col("pos") - h + F.least(h, F.coalesce("known", F.lit(0))) + 1).alias("depth"), "key", "size"
    )
    takers = conversations.where(~heads).select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("head"))
    taken = takers.join(first, "head").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "size")
    same = turns.where(heads).select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "size")
    return stage(same.unionByName(own).unionByName(taken), "rebuilt"), conversations


def _lanes() -> dict[str, Column]:
    """128 bits of a turn at its depth; a prefix is the exclusive or over its turns."""
    return {"x": F.xxhash64("key", "depth"), "y": F.xxhash64("depth", "key")}


def sequences(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per different sequence: ``rep`` (smallest conv_id), ``n``, ``length``, ``ends`` (SHA-256 of all its ids)."""
    marks = turns.withColumns(_lanes()).groupBy("conv_id").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("length")
    )
    marks = conversations.join(marks, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("x", "y", "length")]
    )
    names = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    blocks = marks.groupBy("x", "y", "length", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.array_join(names, ",").alias("ids"), F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")
    )
    ordered = blocks.repartition("x", "y").sortWithinPartitions("x", "y", "length", "block")
    return ordered.select("x", "y", "length", "ids", "rep", "n").mapInArrow(
        _digests, "rep long, n long, length long, ends string"
    )


def _digests(batches):
    """Blocks of ids of one sequence come one after another; they are hashed as they come."""
    known, rep, n, length, digest = None, 0, 0, 0, None
    for batch in batches:
        done = []
        for *sequence, ids, least, held in zip(*[batch.column(c).to_pylist() for c in range(6)], strict=True):
            if sequence == known:
                digest.update(b"," + ids.encode())
                n += held
                continue
            if known is not None:
                done.append((rep, n, length, digest.hexdigest()))
            known, rep, n, length, digest = sequence, least, held, sequence[2], hashlib.sha256(ids.encode())
        if done:
            yield _rows(done)
    if known is not None:
        yield _rows([(rep, n, length, digest.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["rep", "n", "length", "ends"])


@dataclass
class DoubleArray:
    """A trie over rows of dense symbols: the child by symbol t of slot s is slot base[s] + t if its check is s.

    Slot 0 is the node above all first symbols.
    """

    base: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray) -> DoubleArray:
        """From sorted rows of symbols from 0, padded with -1 at their ends."""
        rows, width = symbols.shape
        fresh = np.ones((rows, width), bool)
        fresh[1:] = np.logical_or.accumulate(symbols[1:] != symbols[:-1], axis=1)
        fresh &= symbols >= 0
        node = np.zeros((rows, width + 1), np.int64)
        node[:, 1:][fresh] = np.arange(1, fresh.sum() + 1)
        np.maximum.accumulate(node, axis=0, out=node)
        parent, symbol = node[:, :-1][fresh], symbols[fresh]
        order = np.argsort(parent, kind="stable")
        holders, first, count = np.unique(parent[order], return_index=True, return_counts=True)
        base = np.zeros(len(symbol) + 1, np.int64)
        taken = np.zeros(2 * len(symbol) + 2 * (symbol.max(initial=0) + 2), bool)
        taken[0], top = True, 1
        for at in np.argsort(-count, kind="stable")[: int((count > 1).sum())]:
            wanted = np.sort(symbol[order[first[at]: first[at] + count[at]]])
            wanted -= (least := wanted[0])
            for start in [*(np.flatnonzero(~taken[: top + TRIES])[:TRIES]), top]:
                if start + wanted[-1] >= len(taken):
                    taken = np.concatenate([taken, np.zeros(len(taken) + wanted[-1], bool)])
                if not taken[start + wanted].any():
                    break
            taken[start + wanted] = True
            top = max(top, start + int(wanted[-1]) + 1)
            base[holders[at]] = start - least
        # A node with one child takes the next free slot for it.
        single = first[count == 1]
        free = np.flatnonzero(~taken)
        if len(free) < len(single):
            free = np.concatenate([free, np.arange(len(taken), len(taken) + len(single) - len(free))])
        base[parent[order[single]]] = free[: len(single)] - symbol[order[single]]
        slot = np.zeros(len(symbol) + 1, np.int64)
        slot[1:] = base[parent] + symbol
        size = int(slot.max()) + 1
        out = cls(np.zeros(size, np.int64), np.full(size, -1, np.int64))
        out.base[slot] = base
        out.check[slot[1:]] = slot[parent]
        return out

    def walk(self, symbols: np.ndarray) -> np.ndarray:
        """For all rows at once the slots that they pass; -1 beyond their ends or where no node is."""
        at = np.zeros(len(symbols), np.int64)
        slots = np.full(symbols.shape, -1, np.int64)
        for depth in range(symbols.shape[1]):
            known = (symbols[:, depth] >= 0) & (at >= 0)
            to = np.where(known, self.base[at] + symbols[:, depth], -1)
            known &= (to >= 0) & (to < len(self.check))
            known[known] = self.check[to[known]] == at[known]
            at = np.where(known, to, -1)
            slots[:, depth] = at
        return slots


_NODE = (
    "x long, y long, up_x long, up_y long, depth long, conv_id long, parent_conv_id long, n_convs long, size long, ends string, "
    "n_children long, n_leaves long, saved_tokens long, below_children long, below_leaves long, below_saved long, open boolean, "
    "above array<struct<x: long, y: long>>"
)


def _shards(start: int):
    """Sorted rows (anchor, sequence, path) to nodes; depths count from ``start`` at the anchors."""

    def nodes(batches):
        held, width = [], 0
        for batch in batches:
            # Batches are cut so that rows times the longest path stay within the bound.
            lengths = np.diff(batch.column("path").offsets.to_numpy()) + 1
            begin = 0
            for row, length in enumerate(lengths):
                rows = sum(map(len, held)) + row - begin
                if rows and (rows + 1) * max(width, length) > SHARD_CELLS:
                    yield _shard_nodes([*held, batch.slice(begin, row - begin)], start)
                    held, width, begin = [], 0, row
                width = max(width, length)
            held.append(batch.slice(begin))
        if sum(map(len, held)):
            yield _shard_nodes(held, start)

    return nodes


def _shard_nodes(batches: list[pa.RecordBatch], start: int) -> pa.RecordBatch:
    table = pa.Table.from_batches([b for b in batches if len(b)]).combine_chunks()
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    number = {c: column[c].fill_null(0).to_numpy() for c in ("ax", "ay", "rep", "n", "below_children", "below_leaves", "below_saved")}
    path = column["path"]
    lengths = np.diff(path.offsets.to_numpy())
    part = {f: path.flatten().field(f).to_numpy() for f in ("turn", "x", "y", "size")}
    rows, width = len(lengths), int(lengths.max()) + 1
    inside = np.arange(width - 1) < lengths[:, None]

    def grid(values, first, fill):
        out = np.full((rows, width), fill, np.int64)
        out[:, 0] = first
        out[:, 1:][inside] = values
        return out

    turns, ids = np.unique(part["turn"], return_inverse=True)
    anchor = np.cumsum(np.concatenate([[0], (np.diff(number["ax"]) != 0) | (np.diff(number["ay"]) != 0)]))
    symbols = grid(ids, len(turns) + anchor, -1)
    trie = DoubleArray.of(symbols)
    slots = trie.walk(symbols)
    here = slots >= 0
    row, level = np.nonzero(here)
    slot = slots[here]
    names, first, of = np.unique(slot, return_index=True, return_inverse=True)
    count = len(names)
    place = np.full(len(trie.check), -1, np.int64)
    place[names] = np.arange(count)
    parent = place[trie.check[names]]  # -1 for anchors, whose check is the node above all
    parent[trie.check[names] == 0] = -1
    x = np.bitwise_xor.accumulate(grid(part["x"], number["ax"], 0), axis=1)[here][first]
    y = np.bitwise_xor.accumulate(grid(part["y"], number["ay"], 0), axis=1)[here][first]
    size, depth = grid(part["size"], 0, 0)[here][first], level[first]
    n = np.bincount(of, number["n"][row], count).astype(np.int64)
    conv = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(conv, of, number["rep"][row])
    last = place[slots[np.arange(rows), lengths]]
    ends = np.full(count, None, object)
    # Of the sequences that reach one node at their cut, one ends there at most, and the others agree on what follows.
    ending = column["ends"].is_valid().to_numpy(zero_copy_only=False)
    ends[last[ending]] = column["ends"].drop_null().to_pylist()
    below = {c: np.zeros(count, np.int64) for c in ("below_children", "below_leaves", "below_saved")}
    for c, values in below.items():
        np.maximum.at(values, last, number[c])
    open_ = np.zeros(count, bool)
    for edge in (0, -1):
        open_[place[slots[edge][slots[edge] >= 0]]] = True

    children = np.bincount(parent[(parent >= 0) & ~open_], minlength=count)
    children_all = children + below["below_children"]
    leaves = np.where(open_, 0, (children_all == 0) + below["below_leaves"])
    saved = np.where(open_, 0, (n - 1) * size + below["below_saved"])
    for d in range(width - 1, 0, -1):
        at = np.flatnonzero(depth == d)
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    closed_parent = (parent >= 0) & ~open_[parent]
    above = np.full(count, None, object)
    for edge in (0, rows - 1):
        line = place[slots[edge][slots[edge] >= 0]]
        for d, at in enumerate(line):
            above[at] = [{"x": int(x[a]), "y": int(y[a])} for a in line[: d + 1]]
    top = parent < 0
    nothing = np.zeros(count, bool)

    def array(values, missing=nothing):
        return pa.array(values, pa.int64(), mask=missing)

    struct = pa.struct([("x", pa.int64()), ("y", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [
            array(x), array(y), array(x[parent], top), array(y[parent], top), array(depth + start), array(conv),
            array(conv[parent], ~closed_parent), array(n), array(size), pa.array(ends, pa.string()),
            array(np.where(open_, children, children_all)), array(leaves), array(saved),
            *[array(below[c]) for c in ("below_children", "below_leaves", "below_saved")],
            pa.array(open_), pa.array(above, pa.list_(struct)),
        ],
        [f.split()[0] for f in _NODE.split(", above")[0].split(", ")] + ["above"],
    )


def _merged(nodes: DataFrame) -> DataFrame:
    """Nodes of several shards made one; the others as they are."""
    part = nodes.where("open").groupBy("x", "y").agg(
        *[F.max(c).alias(c) for c in ("up_x", "up_y", "depth", "size", "ends", "below_children", "below_leaves", "below_saved", "above")],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    part = stage(part, "shared")
    open_children = part.where("up_x is not null").groupBy(F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(
        F.count(F.lit(1)).alias("open_children")
    )
    part = part.join(open_children, ["x", "y"], "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)) + F.col("below_children")
    )
    own = part.select(
        F.explode("above").alias("at"),
        (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.col("below_leaves")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size") + F.col("below_saved")).alias("saved"),
    )
    sums = own.groupBy(F.col("at.x").alias("x"), F.col("at.y").alias("y")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    columns = ["x", "y", "up_x", "up_y", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    part = stage(
        part.join(sums, ["x", "y"]).withColumns(
            {"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved")}
        ).select(*columns),
        "shared",
    )
    known = part.select(F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    closed = nodes.where("not open and parent_conv_id is not null").select(*columns, "parent_conv_id")
    under = nodes.where("not open and parent_conv_id is null").select(*columns)
    return closed.unionByName(part.unionByName(under).join(known, ["up_x", "up_y"], "left").select(*columns, "parent_conv_id"))


def prefix_nodes(turns: DataFrame, conversations: DataFrame, *, cut: int = CUT) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, key, size) of all ``conversations`` (conv_id).

    Per node conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    kinds = stage(sequences(turns, conversations), "sequences")
    longest = kinds.agg(F.max("length")).first()[0]
    levels = 0 if longest is None else max(-(-longest // cut), 1)
    rows = turns.withColumns(_lanes()).withColumn("turn", F.xxhash64("key")).drop("key")
    rows = stage(rows.join(kinds.where("length > 0").select("rep"), F.col("conv_id") == F.col("rep")).drop("conv_id"), "sequences")
    found, hung = [], None
    for level in reversed(range(levels)):
        start, end = level * cut, (level + 1) * cut
        paths = rows.where((F.col("depth") > start) & (F.col("depth") <= end)).groupBy("rep").agg(
            F.array_sort(F.collect_list(F.struct("depth", "turn", "x", "y", "size"))).alias("path")
        )
        here = kinds.where(F.col("length") > start if level else F.lit(True)).join(paths, "rep", "left")
        nothing = F.expr("cast(array() as array<struct<depth: bigint, turn: bigint, x: bigint, y: bigint, size: bigint>>)")
        here = here.withColumns(
            {"path": F.coalesce("path", nothing), "ends": F.when(F.col("length") <= end, F.col("ends"))}
        )
        if level:
            anchors = rows.where(F.col("depth") <= start).groupBy("rep").agg(F.bit_xor("x").alias("ax"), F.bit_xor("y").alias("ay"))
            here = here.join(anchors, "rep")
        else:
            here = here.withColumns({c: F.lit(0).cast("long") for c in ("ax", "ay")})
        below = ["below_children", "below_leaves", "below_saved"]
        if hung is None:
            here = here.withColumns({c: F.lit(None).cast("long") for c in below})
        else:
            joins = rows.where(F.col("depth") <= end).groupBy("rep").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
            goes_on = kinds.where(F.col("length") > end).select("rep").join(joins, "rep").join(hung, ["x", "y"]).select("rep", *below)
            here = here.join(goes_on, "rep", "left")
        here = here.select("ax", "ay", "rep", "n", "ends", "path", *below, F.transform("path", lambda p: p["turn"]).alias("order"))
        sharded = here.repartitionByRange("ax", "ay", "order").sortWithinPartitions("ax", "ay", "order").drop("order")
        nodes = stage(_merged(stage(sharded.mapInArrow(_shards(start), _NODE), "nodes")), "nodes")
        if level:
            hung = nodes.where(F.col("depth") == start).select(
                "x", "y", F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"),
                F.col("saved_tokens").alias("below_saved"),
            )
            nodes = nodes.where(F.col("depth") > start)
        found.append((level, nodes))
    if not found:
        found = [(0, kinds.sparkSession.createDataFrame([], "x long, y long, up_x long, up_y long, depth long, conv_id long, "
                 "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent_conv_id long"))]
    out = None
    for (level, nodes), upper in zip(found, [*[n for _, n in found[1:]], None], strict=True):
        if upper is not None:
            # The first nodes of a level hang on nodes of the level above, which know all their members.
            first = F.col("depth") == level * cut + 1
            known = upper.select(F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("known"))
            joined = nodes.where(first).join(known, ["up_x", "up_y"]).withColumn("parent_conv_id", F.col("known")).drop("known")
            nodes = nodes.where(~first).unionByName(joined)
        out = nodes if out is None else out.unionByName(nodes)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_nodes(*rebuilt_turns(numbered_turns(conversations)))
