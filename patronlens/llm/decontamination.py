"""Documents that hold passages of a benchmark, found by spaced seeds.

A seed is a fixed mask over consecutive tokens: positions under a 0 are ignored, so a hit
survives substituted tokens there.  Every document window under every mask is hashed and
joined with the benchmark's hashes.  A hit puts a document and an item on a diagonal;
along it the longest stretch with few substitutions decides.  Items too short for a seed
are found by the hash of all their tokens.

The benchmark is the small side.  It travels to the tasks in blocks of at most
``BLOCK_TOKENS`` tokens, so any benchmark fits; the documents are read once per block and
are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronlens.llm.words import Words, mixed, powers, row_ranges, split_words

MASKS = ("110100111", "1011001011", "11100010011")
# A stretch counts if it has so many equal tokens (or nearly the whole item, if that is shorter) ...
LEAST_EQUAL = 13
LEAST_SHARE = 0.75
# ... and every substitution in it is paid for by so many equal tokens.
SUBSTITUTION_COST = 3
# Items of fewer tokens are too short for seeds: they are looked for whole, without substitutions.
LEAST_ITEM_TOKENS = 9
BLOCK_TOKENS = 2_000_000
_FILTER_BITS = 24

_TO_SPACE = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(128)) + bytes(range(128, 256))
_MARKS = re.compile("[ -¿ -⁯　-〿]+")
# Full-width punctuation, and the letters of scripts that put no space between words.
_WIDE_MARKS = "\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_UNSPACED = re.compile(f"[{_WIDE_MARKS}]|([\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff])")


def tokens(texts: list[bytes]) -> Words:
    """Lower-case runs of letters and digits; in scripts without spaces every letter is a token."""
    plain = [t.lower() if t.isascii() else _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", t.decode().lower())).encode() for t in texts]
    return split_words([t.translate(_TO_SPACE) for t in plain])


def _seed_hashes(words: Words, hashes: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of all windows under ``mask`` that lie in one text."""
    whole = len(hashes) - len(mask) + 1
    if whole <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    summed = np.zeros(whole, np.uint64)
    for step, factor in zip((i for i, bit in enumerate(mask) if bit == "1"), powers(len(mask), 0xE7037ED1A0B428DB)):
        summed += hashes[step: step + whole] * factor
    text = words.text_of()
    at = np.flatnonzero(text[:whole] == text[len(mask) - 1:])
    return at, mixed(summed[at] + np.uint64(MASKS.index(mask)))


@dataclass
class Benchmark:
    """One block of items: their tokens, and for all masks their sorted seeds with item and place.

    ``short`` has the items too short for seeds, by their number of tokens: sorted hashes of whole items, and the items.
    """

    ids: list
    hashes: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    shift: np.uint64
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Benchmark:
        words = tokens(texts)
        hashes = words.hashes()
        enough = words.counts >= LEAST_ITEM_TOKENS
        short = {}
        for size in np.unique(words.counts[(words.counts > 0) & ~enough]).tolist():
            own = np.flatnonzero(words.counts == size)
            starts, whole = words.windows(hashes, size)
            whole = whole[np.searchsorted(starts, words.first[own])]
            order = np.argsort(whole)
            short[size] = (whole[order], own[order])
        found = [_seed_hashes(words, hashes, mask) for mask in MASKS]
        at, seeds = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        item = words.text_of()[at] if len(at) else at
        at, seeds, item = at[enough[item]], seeds[enough[item]], item[enough[item]]
        order = np.argsort(seeds)
        # About 64 places for each seed: few windows without a match get past it.
        bits = min(len(seeds).bit_length() + 6, _FILTER_BITS)
        table = np.zeros(2**bits, bool)
        table[seeds >> np.uint64(64 - bits)] = True
        return cls(ids, hashes, words.first, seeds[order], item[order], (at - words.first[item])[order], table, np.uint64(64 - bits), short)


def _best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and equal tokens of the stretch with the highest score (equal +1, other -cost)."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -SUBSTITUTION_COST))])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    begin = int(np.flatnonzero(total[: end + 1] == lowest[end])[-1])
    return begin, end, int(equal[begin:end].sum())


def matches(texts: list[bytes], block: Benchmark) -> list[list[tuple]]:
    """For each text, (item id, first token, tokens, equal tokens) of every item found in it."""
    words = tokens(texts)
    hashes = words.hashes()
    out: list[list[tuple]] = [[] for _ in texts]
    hits: list[np.ndarray] = []
    text_of = words.text_of()
    for mask in MASKS:
        at, seeds = _seed_hashes(words, hashes, mask)
        may = block.filter[seeds >> block.shift]
        at, seeds = at[may], seeds[may]
        low, high = np.searchsorted(block.seeds, seeds), np.searchsorted(block.seeds, seeds, "right")
        counts = high - low
        if counts.sum():
            entry = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            at = np.repeat(at, counts)
            # A diagonal: the document token that lies under the item's first one.
            hits.append(np.stack([text_of[at], block.item[entry], at - block.place[entry]], 1))
    for size, (whole, items) in block.short.items():
        at, windows = words.windows(hashes, size)
        low, high = np.searchsorted(whole, windows), np.searchsorted(whole, windows, "right")
        counts = high - low
        if counts.sum():
            entry = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            at = np.repeat(at, counts)
            # An item's first copy in a text is enough.
            _, first = np.unique(np.stack([text_of[at], items[entry]], 1), axis=0, return_index=True)
            hits.append(np.stack([text_of[at], items[entry], at], 1)[first])
    if not hits:
        return out
    best: dict[tuple[int, int], tuple] = {}
    for text, item, shift in np.unique(np.concatenate(hits), axis=0).tolist():
        own = block.hashes[block.first[item]: block.first[item + 1]]
        low, high = max(words.first[text], shift), min(words.first[text + 1], shift + len(own))
        begin, end, equal = _best_stretch(hashes[low:high] == own[low - shift: high - shift])
        if equal >= min(LEAST_EQUAL, np.ceil(LEAST_SHARE * len(own))) and equal > best.get((text, item), (0,))[0]:
            best[text, item] = (equal, int(low + begin - words.first[text]), end - begin)
    for (text, item), (equal, begin, length) in best.items():
        out[text].append((block.ids[item], begin, length, equal))
    return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[Benchmark]:
    """The items in blocks of about ``limit`` tokens, dealt by hash."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    # A word and its space, or a letter of a script without spaces, seldom has fewer than three bytes.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(-(-size // (limit * 3)), 1)
    for number in range(count):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).collect()
        if own:
            yield Benchmark.of([r["item_id"] for r in own], [r["text"].encode() for r in own])


def find_passages(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``key, hits`` for every row of ``docs``: an array of (item_id, begin, tokens, equal), in tokens.

    A null or empty text has no hits, and neither has anything if the benchmark is empty.
    Repeated items are reported each.  Nothing is shuffled: with several blocks, rows pass
    through one search after another.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    hit = "array<struct<item_id: long, begin: long, tokens: long, equal: long>>"
    arrow_hit = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "begin", "tokens", "equal")]))
    rows = docs.select(F.col(key).alias("key"), F.col("text").alias("text"), F.array().cast(hit).alias("hits"))
    for block in _blocks(benchmark, block_tokens):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in row_ranges(batches):
                hits = [
                    before + [dict(zip(("item_id", "begin", "tokens", "equal"), h)) for h in sorted(own, key=lambda h: (h[1], h[0] or 0))]
                    for before, own in zip(batch.column(2).to_pylist(), matches(texts, shared.value))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, arrow_hit)], ["key", "text", "hits"])

        rows = rows.mapInArrow(search, f"key {kind}, text string, hits {hit}")
    return rows.select(F.col("key").alias(key), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``key, contaminated, n_items, items, equal_tokens`` for every row of ``docs``."""
    hits = find_passages(docs, benchmark, key=key, block_tokens=block_tokens)
    return hits.select(
        key,
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.array_join(F.transform("hits", lambda h: F.coalesce(h["item_id"].cast("string"), F.lit("none"))), ",").alias("items"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda most, h: F.greatest(most, h["equal"])).alias("equal_tokens"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a passage of the benchmark."""
    spark = docs.sparkSession
    names = docs.columns
    rows = docs
    for block in _blocks(benchmark, block_tokens):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in row_ranges(batches):
                yield batch.filter(pa.array([not own for own in matches(texts, shared.value)], pa.bool_()))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.select(*names)
