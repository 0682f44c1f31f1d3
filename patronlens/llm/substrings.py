"""Removal of word windows that an earlier document already has.

Every window of ``size`` words of every document gets a rolling hash.  Spark brings equal
hashes together and finds the smallest document id of each; a window in a document with
a larger id is a repeat.  Repeated windows of a document merge into maximal intervals of
words, which are cut out.

The hashes travel packed.  A task sorts the windows of a chunk of documents and keeps one
entry per different hash, that of the chunk's smallest document; what other documents of
the chunk repeat is settled there.  So a window that a third of all documents share
sends one entry per chunk.  Entries are dealt by the top bits of their hash, as
compressed differences of sorted hashes, each with its document and its place in it; what
else a chunk knows of its documents goes along once.  Answers go back by chunk and reach
the documents as word intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from patronlens.llm.words import row_ranges, split_words

WINDOW = 13
# Windows that a task sorts at once, and that meet in one group (both about 100 MB).
CHUNK_WINDOWS = 3_000_000
GROUP_WINDOWS = 2_000_000


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, all first bytes of the numbers, then all second bytes and so on."""
    planes = b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(packed: bytes, count: int, *kinds: type) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at: at + width * count].reshape(width, count).T).view(kind).ravel())
        at += width * count
    return out


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


class _Chunk:
    """Windows of some documents, in the order in which they came."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, docs: np.ndarray, keys: np.ndarray, texts: list[bytes], window: int) -> None:
        words = split_words(texts)
        at, hashes = words.windows(words.hashes(), window)
        self.hashes.append(hashes)
        self.docs.append(docs)
        self.keys.append(keys)
        self.counts.append(np.maximum(words.counts - (window - 1), 0))
        self.size += len(hashes)

    def rows(self, number: int, bits: int) -> Iterator[tuple]:
        """(bucket, chunk, entries, packed entries, smallest document) and, with the first bucket alone, what the
        chunk's answers need: (documents, packed documents, packed keys, packed settled windows)."""
        hashes, docs, keys = np.concatenate(self.hashes), np.concatenate(self.docs), np.concatenate(self.keys)
        counts = np.concatenate(self.counts).astype(np.uint32)
        self.__init__()
        if not len(hashes):
            return
        by_doc = np.argsort(docs, kind="stable")
        begins = np.cumsum(counts, dtype=np.int64) - counts
        docs, keys, counts, begins = docs[by_doc], keys[by_doc], counts[by_doc], begins[by_doc]
        ends = np.cumsum(counts, dtype=np.int64)
        hashes = hashes[np.repeat(begins - (ends - counts), counts) + np.arange(len(hashes))]
        doc_of = np.repeat(docs, counts)
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = _groups(hashes)
        sizes = np.diff(np.append(first, len(hashes)))
        doc_of = doc_of[order]
        least = np.minimum.reduceat(doc_of, first)
        spread = np.repeat(least, sizes)
        settled = np.zeros(len(order), bool)
        settled[order[doc_of > spread]] = True
        places = np.minimum.reduceat(np.where(doc_of == spread, order, len(order)), first)
        # Places count from the first row of the document's id.
        places = (places - (ends - counts)[np.searchsorted(docs, least)]).astype(np.uint32)
        offsets = least.view(np.uint64) - docs[:1].view(np.uint64)
        hashes = hashes[first]
        own = (len(docs), _pack(docs, counts), _pack(keys), zstandard.ZstdCompressor(level=1).compress(np.packbits(settled).tobytes()))
        cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64)) if bits else [0, len(hashes)]
        for bucket in range(2**bits):
            part = slice(cuts[bucket], cuts[bucket + 1])
            count = int(cuts[bucket + 1] - cuts[bucket])
            if count or bucket == 0:
                steps = np.diff(hashes[part], prepend=np.uint64(0))
                packed = _pack(steps, offsets[part], places[part])
                yield bucket, number, count, packed, int(docs[0]), *(own if bucket == 0 else (0, None, None, None))


_ENTRIES = "bucket long, chunk long, entries long, packed binary, base long, documents long, owners binary, keys binary, settled binary"
_ANSWERS = "chunk long, repeats long, packed binary, documents long, owners binary, keys binary, settled binary"
_SPANS = "doc_id long, text_hash long, spans binary"


def _names(shape: str) -> list[str]:
    return [column.split()[0] for column in shape.split(", ")]


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """Entries of one bucket, from all chunks: which of them have an equal hash in a smaller document."""
    hashes, docs, places, chunks = [], [], [], []
    for i, row in enumerate(frame.itertuples()):
        steps, offsets, place = _unpack(row.packed, row.entries, np.uint64, np.uint64, np.uint32)
        hashes.append(np.cumsum(steps, dtype=np.uint64))
        docs.append((offsets + np.array([row.base], np.int64).view(np.uint64)).view(np.int64))
        places.append(place)
        chunks.append(np.full(len(place), i, np.int32))
    hashes, docs = np.concatenate(hashes), np.concatenate(docs)
    places, chunks = np.concatenate(places), np.concatenate(chunks)
    repeated = np.zeros(len(hashes), bool)
    if len(hashes):
        order = np.argsort(hashes)
        first = _groups(hashes[order])
        own = docs[order]
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
        repeated[order[own > least]] = True
    found = np.flatnonzero(repeated)
    found = found[np.lexsort((places[found], docs[found], chunks[found]))]
    cuts = np.searchsorted(chunks[found], np.arange(len(frame) + 1))
    out = []
    for i, row in enumerate(frame.itertuples()):
        part = found[cuts[i]: cuts[i + 1]]
        if len(part) or row.keys is not None:
            told = (row.documents, row.owners, row.keys, row.settled) if row.keys is not None else (0, None, None, None)
            out.append((row.chunk, len(part), _pack(np.diff(docs[part], prepend=np.int64(0)), places[part]), *told))
    return pd.DataFrame(out, columns=_names(_ANSWERS))


def _by_document(frame: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of one chunk as runs within its documents."""
    (own,) = frame[frame["keys"].notna()].itertuples()
    owner, counts = _unpack(own.owners, own.documents, np.int64, np.uint32)
    (keys,) = _unpack(own.keys, own.documents, np.int64)
    ends = np.cumsum(counts, dtype=np.int64)
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(own.settled), np.uint8)
    marked = np.unpackbits(bits, count=int(ends[-1])).astype(bool)
    for row in frame.itertuples():
        steps, places = _unpack(row.packed, row.repeats, np.int64, np.uint32)
        marked[(ends - counts)[np.searchsorted(owner, np.cumsum(steps))] + places] = True
    at = np.flatnonzero(marked)
    if not len(at):
        return pd.DataFrame([], columns=_names(_SPANS))
    document = np.searchsorted(ends, at, "right")
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(document) != 0)]))
    lengths = np.diff(np.append(begin, len(at)))
    which = document[begin]
    inside = at[begin] - (ends[which] - counts[which])
    runs = np.stack([inside, lengths], 1).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(which) != 0, [True]]))
    rows = [(owner[which[a]], keys[which[a]], runs[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    return pd.DataFrame(rows, columns=_names(_SPANS))


def _without(text: bytes, spans: list[bytes] | None, window: int) -> tuple[int, int, bytes]:
    """Words, removed words and the kept words of a text, given runs of repeated windows."""
    words = text.split(None)
    if not spans:
        return len(words), 0, b" ".join(words)
    split = split_words([text])
    _, hashes = split.windows(split.hashes(), window)
    repeated = np.zeros(len(hashes), bool)
    for run in spans:
        for begin, length in np.frombuffer(run, np.int64).reshape(-1, 2):
            repeated[begin: begin + length] = True
    # A run names one place of a window; the document may hold it elsewhere too.
    repeated = np.isin(hashes, hashes[repeated])
    change = np.zeros(len(words) + 1, np.int64)
    change[: len(hashes)] += repeated
    change[window: window + len(hashes)] -= repeated
    gone = np.cumsum(change[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove_repeats(
    docs: DataFrame, *, window: int = WINDOW, chunk_windows: int = CHUNK_WINDOWS, group_windows: int = GROUP_WINDOWS
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (binary) for every row of ``docs`` (doc_id, text).

    ``docs`` must be a stored table: chunks are named by task, so a task that is run
    again has to see the same rows in the same order.  A null text has no words.  A row
    with a null id keeps everything and counts for no other.  Rows of one id do not
    repeat each other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    named = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(int(chars // 6 // group_windows).bit_length(), 2)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def packed() -> Iterator[pa.RecordBatch]:
            for row in chunk.rows(part << 24 | number, bits):
                arrays = [pa.array([v], pa.binary() if i in (3, 6, 7, 8) else pa.int64()) for i, v in enumerate(row)]
                yield pa.RecordBatch.from_arrays(arrays, _names(_ENTRIES))

        for batch, texts in row_ranges(batches):
            chunk.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts, window)
            if chunk.size >= chunk_windows:
                yield from packed()
                number += 1
        if chunk.size:
            yield from packed()

    entries = named.mapInArrow(windows, _ENTRIES)
    answers = entries.groupBy("bucket").applyInPandas(_meet, _ANSWERS)
    spans = answers.groupBy("chunk").applyInPandas(_by_document, _SPANS)
    spans = spans.groupBy("doc_id", "text_hash").agg(F.collect_list("spans").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_ranges(batches):
            done = [_without(t, s, window) for t, s in zip(texts, batch.column("spans").to_pylist())]
            n_words, n_removed, kept = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = rows.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
