"""Token ids as files of length-delimited binary records, with an offset index.

One record per document, back to back in files of one partition each::

    length    8 bytes, unsigned, of the payload
    check     4 bytes, masked CRC-32 of the length bytes
    payload   1 byte (0: the id is null), 8 bytes document id, then the token ids
    check     4 bytes, masked CRC-32 of the payload
    line feed

All numbers are little-endian.  Token ids take 2 bytes where the vocabulary allows it,
else 4.  The mask keeps a checksum of data that itself holds checksums from being weak.
Files are in ascending order of document id and so are the records in each; nulls come
first and rows of one id are ordered by their text's hash.  The index holds file, offset
and length of every record, so that a reader may take records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronlens.llm.bpe import codec
from patronlens.llm.words import row_ranges
from patronlens.sources.stages import new_stage_path

_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<Bq")
_FOOT = struct.Struct("<I")
# Bytes around a payload, and of the document id in it.
_AROUND, _KEY_BYTES = _HEAD.size + _FOOT.size + 1, _KEY.size
_MASK = 0xA282EAD8
# Bytes of text for one file: its records take about half as many.
FILE_TEXT_BYTES = 256_000_000
# Records that a reader hands on at a time.
RECORDS = 2_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    key = _KEY.pack(0, 0) if doc_id is None else _KEY.pack(1, doc_id)
    payload = key + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + _FOOT.pack(masked_crc(size)) + payload + _FOOT.pack(masked_crc(payload))


def read_frame(data: bytes | memoryview, offset: int, width: int) -> tuple[int | None, np.ndarray, int]:
    """Document id and token ids of the record at ``offset``, and where the next one begins."""
    length, check = _HEAD.unpack_from(data, offset)
    begin = offset + _HEAD.size
    if check != masked_crc(bytes(data[offset: offset + 8])) or begin + length + 4 > len(data):
        raise ValueError(f"no record at offset {offset}")
    payload = bytes(data[begin: begin + length])
    (check,) = _FOOT.unpack_from(data, begin + length)
    if check != masked_crc(payload):
        raise ValueError(f"the record at offset {offset} is damaged")
    known, doc_id = _KEY.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=_KEY.size), begin + length + 5


def write_records(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, width: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) and write their records in ascending order of doc_id.

    A null text has no tokens of its own.  Rows of one doc_id are records of their own, in the order of their
    texts' hashes.  An empty table writes no records.  Files grow in number with the bytes of
    text, so that none becomes too large to be read whole (Spark's limit is 2 GB).
    """
    if width not in (2, 4):
        raise ValueError("token ids take 2 or 4 bytes")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    held = docs.agg(F.sum(F.octet_length("text")).alias("held")).first()["held"] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_TEXT_BYTES))
    rows = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        if len(own.token_text) > 256**width:
            raise ValueError(f"the vocabulary does not fit {width} bytes")
        for part, texts in row_ranges(batches):
            ids = own.encode_texts(texts)
            frames = [frame(d, np.append(i, np.uint32(end_id)), width) for d, i in zip(part.column(0).to_pylist(), ids)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    # The text writer puts a string's bytes as they are; the line feed is the record's last byte.
    rows.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string")).write.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Files of records with their place in the order; a file is one written partition."""
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(number.alias("file"), "path", "content")


def _head(data: bytes, offset: int) -> tuple[int | None, int]:
    """Document id and payload length of the record at ``offset``; the payload's checksum is left to its reader."""
    length, check = _HEAD.unpack_from(data, offset)
    if check != masked_crc(data[offset: offset + 8]) or offset + _AROUND + length > len(data):
        raise ValueError(f"no record at offset {offset}")
    known, doc_id = _KEY.unpack_from(data, offset + _HEAD.size)
    return doc_id if known else None, length


def write_index(spark: SparkSession, path: str, index_path: str, *, width: int = 2) -> DataFrame:
    """Walk the files from head to head and write ``file, path, number, offset, length, before, doc_id, n_tokens``.

    ``before`` counts the token ids of the file's earlier records.  Only heads are read and checked here.
    """
    shape = "file long, path string, number long, offset long, length long, before long, doc_id long, n_tokens long"

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            for number, name, content in files.itertuples(index=False):
                rows, offset, before = [], 0, 0
                while offset < len(content):
                    doc_id, length = _head(content, offset)
                    size = _AROUND + length
                    tokens = (length - _KEY_BYTES) // width
                    rows.append((number, name, len(rows), offset, size, before, doc_id, tokens))
                    offset, before = offset + size, before + tokens
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    _files(spark, path).mapInPandas(walk, shape).write.parquet(index_path)
    return spark.read.parquet(index_path)


def read_records(spark: SparkSession, path: str, index: DataFrame, *, width: int = 2) -> DataFrame:
    """The records that ``index`` (or any part of it) names: file, number, before, doc_id and ``ids`` (4 bytes each).

    A file's wanted offsets travel to the file, never its bytes to them; a file is one
    task's worth of data.  Every record's checksums are tested.
    """
    entry = F.struct("offset", "number", "before")
    wanted = index.groupBy("file").agg(F.collect_list(entry).alias("w")).select("file", "w.offset", "w.number", "w.before")
    shape = "file long, number long, before long, doc_id long, ids binary"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                file, content = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                offsets, numbers, befores = (batch.column(c)[row].values for c in (2, 3, 4))
                places = offsets.to_pylist()
                for begin in range(0, len(places), RECORDS):
                    read = [read_frame(content, at, width) for at in places[begin: begin + RECORDS]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * len(read), pa.int64()), numbers.slice(begin, RECORDS), befores.slice(begin, RECORDS),
                            pa.array([r[0] for r in read], pa.int64()),
                            pa.array([r[1].astype("<u4").tobytes() for r in read], pa.binary()),
                        ],
                        ["file", "number", "before", "doc_id", "ids"],
                    )

    files = _files(spark, path).select("file", "content").join(wanted, "file")
    return files.select("file", "content", "offset", "number", "before").mapInArrow(take, shape)


def token_file_digest(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """Write all documents, index the files, read every record back by the index; one row per document.

    ``start`` counts the token ids of all documents before it, over all files.  See ``write_records``
    for nulls, repeated rows and empty tables.
    """
    spark = docs.sparkSession
    path = new_stage_path(spark, "records")
    write_records(docs, f"{path}/data", tokenizer, end_id=end_id)
    index = write_index(spark, f"{path}/data", f"{path}/index")
    # One row per file, so running totals over them are short.
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("held")).collect()
    bases, base = [], 0
    for row in sorted(totals, key=lambda r: r["file"]):
        bases.append((row["file"], base))
        base += row["held"]
    starts = F.broadcast(spark.createDataFrame(bases, "file long, base long"))
    read = read_records(spark, f"{path}/data", index)
    return read.join(starts, "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
