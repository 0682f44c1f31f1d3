"""Spelling variants: words one edit apart, found by products of letter-count matrices.

Spark counts the words of all documents.  Words are then dealt into blocks, by how many of
their letters fall into each of a few classes of letters, so a block's words are equally
long; one edit changes one class by one, or moves one letter from a class to another, so
partners stand in the same or an adjacent block.  A block of many words is cut into
tiles.  For a pair of tiles, the product of their letter-count matrices gives the squared
distance of all pairs at once: one edit makes it 2 at most (1 for a letter more).
What is left is compared letter by letter.  Tiles are bounded, pairs never reach the driver,
and no pair further apart than two leaves the product.

A run of letters is changed before it is counted, where a checksum of document and run says
so (see ``letter_runs``).  Null texts have no words; a null doc_id counts as empty text.  Repeated
rows count repeatedly.  Very long texts are read in parts that end between runs.  An empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patronlens.llm.words import row_ranges
from patronlens.sources.stages import stage

LEAST_LETTERS = 5
LEAST_COUNT = 3
# A form's count is at least so many times the word's.
FORM_FACTOR = 2
# One run in so many, by checksum, loses one code point.
LOSS_MODULUS = 97
TILE_WORDS = 2048
TASK_TILES = 64
PART_BYTES = 1 << 22
FLUSH_WORDS = 400_000
# Rows of a product at a time; with tiles of 4,096 words it takes 8 MB.
PRODUCT_ROWS = 512

_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % LEAST_LETTERS)
# Letters by code point, numbered: a to z, then U+00C0 to U+00FF.
_LETTERS = 26 + 64
_PLACE = np.zeros(256, np.intp)
_PLACE[ord("a"): ord("z") + 1] = np.arange(26)
_PLACE[0xC0:] = np.arange(26, _LETTERS)
_NOT_IN_RUN = re.compile(rb"[^a-zA-Z\x80-\xff]")


def _parts(text: bytes):
    """The text in parts of PART_BYTES and more, cut at bytes that no run holds."""
    begin = 0
    while len(text) - begin > PART_BYTES:
        cut = _NOT_IN_RUN.search(text, begin + PART_BYTES)
        if cut is None:
            break
        yield text[begin: cut.end()]
        begin = cut.end()
    yield text[begin:] if begin else text


def letter_runs(text: bytes, doc: bytes, counts: Counter) -> None:
    """Add the runs of at least LEAST_LETTERS letters of one document, A-Z in lower case, to ``counts``.

    With h the CRC-32 of ``<doc_id>:<run>``, a run whose h LOSS_MODULUS divides loses its code
    point number h % length.  Shorter runs, before or after, are never words.
    """
    seed = zlib.crc32(doc + b":")
    for part in _parts(text):
        # The lower case of bytes is that of A-Z alone.
        runs = _RUN.findall(part.lower().decode())
        counts.update(runs)
        changed = {run: h for run in set(runs) if not (h := zlib.crc32(run.encode(), seed)) % LOSS_MODULUS}
        if changed:
            for run, times in Counter(r for r in runs if r in changed).items():
                at = changed[run] % len(run)
                counts[run] -= times
                if len(run) > LEAST_LETTERS:
                    counts[run[:at] + run[at + 1:]] += times


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words with LEAST_LETTERS code points and LEAST_COUNT occurrences or more."""

    def counted(batches):
        counts: Counter = Counter()

        def rows():
            words = {w: n for w, n in counts.items() if n}
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"]
            )

        for batch, texts in row_ranges(batches):
            for text, doc in zip(texts, batch.column("doc").to_pylist(), strict=True):
                letter_runs(text, doc.encode(), counts)
                if len(counts) > FLUSH_WORDS:
                    yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    parts = texts.mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _block(classes: int) -> Column:
    """The number of letters in each class; a letter's class is its code point's remainder."""
    letters = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]
    without = [F.translate("word", "".join(x for x in letters if ord(x) % classes == k), "") for k in range(classes)]
    return F.array(*[(F.length("word") - F.length(rest)).cast("int") for rest in without])


def _adjacent(block: Column, classes: int) -> Column:
    """The block itself, those with one letter more, and one of each two that differ by a moved letter."""
    def moved(change: dict[int, int]) -> Column:
        return F.array(*[block[k] + F.lit(change.get(k, 0)) for k in range(classes)])

    more = [moved({k: 1}) for k in range(classes)]
    swapped = [moved({i: 1, j: -1}) for i in range(classes) for j in range(i)]
    return F.array(block, *more, *swapped)


def near_words(words: DataFrame, *, tile_words: int = TILE_WORDS) -> DataFrame:
    """``word, n, near, near_n``: both ways, every two of ``words`` (word, n; distinct) that are one edit apart.

    Words hold letters up to U+00FF only.  The number of classes grows with that of the words,
    so that blocks stay small; the result does not depend on it.
    """
    words = stage(words, "words")
    classes = max(len(str(words.count())) - 1, 2)
    words = words.withColumn("block", _block(classes))
    sizes = words.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile_words).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    tiles = stage(
        words.join(sizes, "block")
        .groupBy("block", tile.alias("tile"))
        .agg(F.sort_array(F.collect_list(F.struct(F.encode("word", "ISO-8859-1").alias("word"), "n"))).alias("held"))
        .select("block", "tile", F.col("held.word").alias("words"), F.col("held.n").alias("counts")),
        "tiles",
    )
    left = tiles.select(
        F.explode(_adjacent(F.col("block"), classes)).alias("block"), F.col("block").alias("own"),
        F.col("tile").alias("left_tile"), F.col("words").alias("left_words"), F.col("counts").alias("left_counts"),
    )
    inside = F.col("block") == F.col("own")
    left = left.join(sizes, "block").select(
        "block", F.explode(F.sequence(F.when(inside, F.col("left_tile")).otherwise(0), F.col("tiles") - 1)).alias("tile"),
        (inside & (F.col("left_tile") == F.col("tile"))).alias("same"), "left_words", "left_counts",
    )
    # A row is a pair of tiles from here on; its words are bounded by the tile's size.  Tasks are few tiles each,
    # however small these are: it is the products that take time.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles.count() // TASK_TILES)
    pairs = left.repartition(tasks, "block", "tile").join(tiles.repartition(tasks, "block", "tile"), ["block", "tile"])
    return pairs.select("same", "left_words", "left_counts", "words", "counts").mapInArrow(
        _compare, "word string, n long, near string, near_n long"
    )


@dataclass
class _Tile:
    """Equally long words as rows of letter codes, and how often each holds each letter."""

    letters: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> _Tile:
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset: words.offset + len(words) + 1]
        letters = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]: ends[-1]].reshape(len(words), -1)
        places = np.arange(len(words))[:, None] * _LETTERS + _PLACE[letters]
        counts = np.bincount(places.ravel(), minlength=len(words) * _LETTERS).reshape(-1, _LETTERS)
        return cls(letters, counts.astype(np.float32))


def _gram_pairs(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` (``same``: the first before the second) that are at most 2 apart, squared."""
    used = x.any(0) | y.any(0)
    x, y = x[:, used], y[:, used]
    # Squared distance <= 2 where x.y - |y|^2 / 2 >= |x|^2 / 2 - 1; all values are small multiples of a half, so exact.
    x_half, y_half, across = (x * x).sum(1) / 2 - 1, (y * y).sum(1) / 2, np.ascontiguousarray(y.T)
    found_i, found_j = [], []
    for begin in range(0, len(x), PRODUCT_ROWS):
        product = x[begin: begin + PRODUCT_ROWS] @ across
        product -= y_half
        at = np.flatnonzero(product >= x_half[begin: begin + PRODUCT_ROWS, None])
        i, j = np.divmod(at, len(y))
        i += begin
        if same:
            i, j = i[i < j], j[i < j]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` become those of ``b``, as long or one letter longer, by exactly one edit."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(1) == 1
    ends = np.ones((len(a), 1), bool)
    from_start = np.hstack([a != b[:, :size], ends]).argmax(1)
    from_end = np.hstack([(a != b[:, 1:])[:, ::-1], ends]).argmax(1)
    return from_start + from_end >= size


def _compare(batches):
    for batch in batches:
        same = batch.column(0).to_pylist()
        before, right = None, None
        for row in range(len(batch)):
            left_words, left_n, right_words, right_n = (batch.column(c)[row].values for c in range(1, 5))
            left = _Tile.of(left_words)
            # The pairs of one tile come one after another.
            if before is None or not right_words.equals(before):
                before, right = right_words, _Tile.of(right_words)
            i, j = _gram_pairs(left.counts, right.counts, same[row])
            edited = _one_edit(left.letters[i], right.letters[j])
            i, j = pa.array(i[edited]), pa.array(j[edited])
            if not len(i):
                continue
            sides = [(_text(left_words.take(i)), left_n.take(i)), (_text(right_words.take(j)), right_n.take(j))]
            for (word, n), (near, near_n) in (sides, sides[::-1]):
                yield pa.RecordBatch.from_arrays([word, n, near, near_n], ["word", "n", "near", "near_n"])


def _text(words: pa.Array) -> pa.Array:
    return pa.array([w.decode("latin-1") for w in words.to_pylist()], pa.string())


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms (word, form) lead in the end, for every word that has one.

    Counts at least double along a chain, so a chain is short, and every round doubles the steps taken.
    """
    reached = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = stage(
            reached.join(further, "root", "left")
            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, n, n_near, form, form_n, root.

    ``form`` is the near word of largest n (of equals, the first in code-point order), if that is at
    least FORM_FACTOR times the word's n; ``root`` is the end of its chain of forms.
    """
    words = stage(count_words(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= FORM_FACTOR * F.col("n")
    near = stage(
        near.select(
            "word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")
        ),
        "near",
    )
    roots = _roots(near.where("form is not null"))
    return (
        words.join(near, "word", "left").join(roots, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )
