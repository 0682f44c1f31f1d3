"""Near-duplicate documents by bottom-k sketches of their word shingles.

A document's set holds its distinct shingles.  One hash function orders all shingles; a
sketch is the ``K`` smallest hashes of a set.  The steps:

1.  Documents with equal sets form a class; only the smallest id of each goes on.
2.  Inverted lists of the retained values.  Two sets with the wanted similarity share at
    least ``SHARED`` of the ``K`` smallest values of their union (fewer with a probability
    below 1e-7 a pair).  So it is enough to look a sketch up under its
    ``K - SHARED + 1`` rarest values, which keeps values of common passages out unless
    they make up much of a document.  For a set of up to ``K`` shingles the bound is exact:
    three quarters of it, less the values that the largest possible partner has beyond its
    sketch.
3.  Within a list, the similarity that the union of two sketches shows filters pairs.
    What leaves a list is a spanning forest of its passing pairs, so the output is no
    larger than the list.  Lists longer than ``BLOCK`` are compared block by block.
4.  Components of these pairs are groups of possible duplicates.  Full sets are built for
    their documents only, and every pair of a group whose sketches pass is compared
    exactly, unless links found before connect it already.  Again a spanning forest of
    the exact links leaves a block.
5.  Components of the exact links, with the classes put back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patronlens.llm.graph import components
from patronlens.llm.membership import Membership
from patronlens.llm.words import mixed, powers, row_ranges, split_words
from patronlens.sources.stages import stage

SHINGLE_WORDS = 5
K = 32
SHARED = 10
PERCENT = 75
# Documents compared with one another at a time.
BLOCK = 1024
_LAST = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; letters A-Z count as a-z."""
    words = split_words([t.lower() for t in texts])
    hashes = words.hashes()
    at, shingles = words.windows(hashes, size)
    cuts = np.searchsorted(at, words.first)
    sets = []
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a == b and words.first[i] < words.first[i + 1]:
            few = hashes[words.first[i]: words.first[i + 1]]
            sets.append(mixed(np.array([(few * powers(len(few), 0xA0761D6478BD642F)).sum() + np.uint64(len(few))], np.uint64)))
        else:
            sets.append(np.unique(shingles[a:b]))
    return sets


def _fingerprint(values: np.ndarray) -> bytes:
    return np.array([values.sum(), mixed(values).sum()], np.uint64).tobytes()


def sketch_documents(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, mark`` (equal for equal sets) ``, sketch`` (binary) for every row."""
    shape = "doc_id long, n_shingles long, mark binary, sketch binary"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_ranges(batches):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) for s in sets], pa.binary()),
                    pa.array([s[:K].tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "mark", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(sketch, shape)


def _padded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of ``K`` values, filled up with the largest value."""
    out = np.full((len(sketches), K), _LAST)
    for row, sketch in zip(out, sketches):
        values = np.frombuffer(sketch, np.uint64)
        row[: len(values)] = values
    return out


def union_passes(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """Whether the union of two sketches leaves room for the wanted similarity, for one set against others.

    The ``K`` smallest different values of both sketches are the union's own sketch; those
    that stand in both are shared.  Unions of at most ``K`` values are judged exactly.
    """
    both = np.sort(np.concatenate([np.broadcast_to(one, others.shape), others], 1), 1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _LAST)
    rank = np.arange(1, 2 * K)[None, :] - np.cumsum(twice, 1) + 1
    shared = (twice & (rank <= K)).sum(1)
    different = 2 * K - twice.sum(1) - (both == _LAST).sum(1)
    small = (n_one <= K) & (n_others <= K)
    enough = np.where(small, 100 * shared >= PERCENT * different, shared >= np.where(different >= K, SHARED, 1))
    sizes = (100 * n_others >= PERCENT * n_one) & (100 * n_one >= PERCENT * n_others)
    return enough & sizes


class _Forest:
    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def roots(self, items: np.ndarray) -> np.ndarray:
        at = self.parent[items]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def unite(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)


def _two_sided(frame: pd.DataFrame, i: int) -> slice | np.ndarray:
    """Rows after i that i is to be compared with: the other side's, or all of a one-sided block."""
    side = frame["side"].to_numpy()
    later = np.arange(i + 1, len(frame))
    return later if side.max() == side.min() else later[side[later] != side[i]]


def _passing_forest(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of one list (or pair of blocks) whose union sketches pass."""
    docs, n = frame["rep"].to_numpy(), frame["n_shingles"].to_numpy()
    sketches, forest, out = _padded(list(frame["sketch"])), _Forest(len(frame)), []
    for i in range(len(frame) - 1):
        later = _two_sided(frame, i)
        later = later[forest.roots(later) != forest.root(i)]
        if len(later):
            for j in later[union_passes(sketches[i], int(n[i]), sketches[later], n[later])].tolist():
                if forest.root(i) != forest.root(j):
                    forest.unite(i, j)
                    out.append((int(docs[i]), int(docs[j])))
    return out


def _exact_forest(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """Spanning forest of the exact links within one group (or pair of its blocks)."""
    docs, sets = frame["rep"].to_numpy(), [np.frombuffer(s, np.uint64) for s in frame["set"]]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    sketches = _padded([s[:K].tobytes() for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(n) - n
    mark = np.zeros(int(local.max()) + 1, bool)
    forest, out = _Forest(len(sets)), []
    for i in range(len(sets) - 1):
        later = _two_sided(frame, i)
        later = later[forest.roots(later) != forest.root(i)]
        if len(later):
            later = later[union_passes(sketches[i], int(n[i]), sketches[later], n[later])]
        if not len(later):
            continue
        mine = local[begins[i]: begins[i] + n[i]]
        mark[mine] = True
        for j in later.tolist():
            if forest.root(i) != forest.root(j):
                common = int(mark[local[begins[j]: begins[j] + n[j]]].sum())
                if 100 * common >= PERCENT * (n[i] + n[j] - common):
                    forest.unite(i, j)
                    out.append((int(docs[i]), int(docs[j])))
        mark[mine] = False
    return out


def _blocked(rows: DataFrame, key: str, sizes: DataFrame, weight: int) -> DataFrame:
    """Rows dealt to ``bin, key, low, high, side``: small keys share bins, large ones meet block by block.

    ``sizes`` holds ``key, members``.  A key of more than ``BLOCK`` members is cut into
    blocks by hash, and every pair of blocks meets once in a bin of its own.
    """
    total = sizes.agg(F.sum("members")).first()[0] or 0
    bins = max(int(total // weight), 1)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(sizes, key).withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    place = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(key), F.lit(bins))).otherwise(F.xxhash64(key, "low", "high"))
    return dealt.withColumn("bin", place).withColumn("side", F.col("own")).drop("blocks", "own", "other", "members")


def _compared(dealt: DataFrame, key: str, compare) -> DataFrame:
    def in_bin(frame: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for _, rows in frame.groupby([key, "low", "high"], sort=False):
            if len(rows) > 1:
                links += compare(rows)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("bin").applyInPandas(in_bin, "a long, b long")


def _look_ups(reps: DataFrame) -> DataFrame:
    """``value, rep``: each sketch under its rarest values, values of one sketch only left out."""
    values = F.expr(f"transform(sequence(0, cast(octet_length(sketch) / 8 as int) - 1), i -> substring(sketch, 8 * i + 1, 8))")
    every = reps.select("rep", "n_shingles", F.explode(values).alias("value"))
    every = every.select("rep", "n_shingles", F.conv(F.hex("value"), 16, -10).cast("long").alias("value"))
    held = every.groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    found = every.join(held, "value").groupBy("rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("found"))
    # Values that no other sketch has are the rarest of all: they take the first places.
    kept = F.least(F.lit(K), F.col("n_shingles"))
    # Of a set that a sketch holds whole, the largest partner's sketch may lack what goes beyond ``K`` there.
    partner = F.floor(F.col("n_shingles") * 100 / PERCENT)
    shown = F.least(F.ceil(F.col("n_shingles") * PERCENT / 100), F.col("n_shingles") - F.greatest(partner - K, F.lit(0)))
    needed = F.when(F.col("n_shingles") <= K, shown).otherwise(F.lit(SHARED))
    first = (kept - needed + 1) - (kept - F.size("found"))
    wanted = F.slice("found", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    return found.select("rep", F.explode(wanted).alias("found")).select("rep", F.col("found.value").alias("value"), F.col("found.held").alias("held"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    A text with fewer than ``size`` words has one shingle, its whole word sequence; a null
    text or one without words has none and is linked with nothing.  Rows of one id are one
    node of the links.  A row with a null id is linked with nothing, has a null component and is kept.
    """
    rows = stage(sketch_documents(docs, size), "sketches")
    joinable = rows.where("doc_id is not null and n_shingles > 0")
    classes = stage(joinable.groupBy("n_shingles", "mark").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")

    looked_up = stage(_look_ups(classes), "look-ups")
    sizes = looked_up.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    listed = looked_up.select("value", "rep").join(classes.select("rep", "n_shingles", "sketch"), "rep")
    passing = stage(_compared(_blocked(listed, "value", sizes, 4 * BLOCK), "value", _passing_forest), "passing")

    groups = stage(components(passing), "groups")
    wanted = Membership.of(groups.select("node"))
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column(0).to_numpy())))
            for part, texts in row_ranges(iter([batch])):
                found = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_fingerprint(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["node", "mark", "set"],
                )

    # An id may have several rows with different sets: the class's own set is the one to compare.
    sets = sets.mapInArrow(full_sets, "node long, mark binary, set binary").dropDuplicates(["node", "mark"])
    members = groups.join(classes.select(F.col("rep").alias("node"), "mark"), "node").join(sets, ["node", "mark"])
    members = members.select(F.col("component").alias("group"), F.col("node").alias("rep"), "set")
    sizes = groups.groupBy(F.col("component").alias("group")).agg(F.count(F.lit(1)).alias("members"))
    exact = _compared(_blocked(members, "group", sizes, BLOCK), "group", _exact_forest)

    # All ids of a class, and all classes of an id, are linked.
    owners = joinable.select("doc_id", "n_shingles", "mark").join(classes.drop("sketch"), ["n_shingles", "mark"])
    same = owners.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(exact.unionByName(same))
    labelled = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return labelled.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
