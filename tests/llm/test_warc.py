from __future__ import annotations

import base64
import hashlib

import pytest

from patronlens.llm.warc import archive_round_trip, mark_revisits, read_warc, write_warc

FALSE_RECORD = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
)


def expected(rows, min_bytes=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, data in payloads:
        ids = [k for k, d in payloads if d == data and k is not None]
        holder = max(ids) if len(data) >= min_bytes and ids else None
        revisit = holder is not None and holder != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=repr)


def told(df):
    rows = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture
def make_pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string")


ROWS = [
    (1, "http://a/", "plain"), (2, "http://b/", "plain"), (9, "http://c/", "plain"), (3, None, None), (4, "http://d/", ""),
    (5, "http://e/", FALSE_RECORD), (6, "http://f/", "x" + FALSE_RECORD * 3 + "WARC/1.1\r\n"), (7, "u\r\nWARC-Type: revisit\r\n\r\nv w", "WARC/1.1\r\n" * 5),
    (8, "http://g/é", "é漢🙂\r\n\r\n" * 40), (10, "http://h/", "y" * 200_000), (11, "http://i/", "\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n"),
    (None, "http://j/", "plain"), (None, "http://k/", "only here"), (12, "http://l/", "twice"), (12, "http://l/", "twice"), (-3, "http://m/", "\r\n"),
]


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(make_pages, min_bytes):
    assert told(archive_round_trip(make_pages(ROWS).coalesce(2), min_bytes)) == expected(ROWS, min_bytes)


def test_archives_split_between_tasks(spark, make_pages, tmp_path):
    rows = [(i, f"http://s/{i}", (FALSE_RECORD if i % 3 else "z") * (1 + i % 7)) for i in range(200)]
    write_warc(mark_revisits(make_pages(rows)).coalesce(1), f"{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("part-*")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert told(read_warc(spark, f"{tmp_path}/w")) == expected(rows)
        data = file.read_bytes()
        file.with_name(f".{file.name}.crc").unlink()
        at = data.index(b"zzzz")
        # A lost byte breaks the chain; a changed one does not fit its digest.
        for damaged in (data[:at] + data[at + 1:], data[:at] + b"y" + data[at + 1:]):
            file.write_bytes(damaged)
            with pytest.raises(ValueError):
                read_warc(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_pages(make_pages):
    assert archive_round_trip(make_pages([])).collect() == []


def test_second_reading_may_be_packed_otherwise(spark, make_pages, tmp_path, monkeypatch):
    from patronlens.llm import warc

    rows = [(i, f"http://s/{i}", (FALSE_RECORD if i % 3 else "z") * (1 + i % 7)) for i in range(200)]
    write_warc(mark_revisits(make_pages(rows)).repartition(4), f"{tmp_path}/w")
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    pieces, readings = warc._pieces, []

    def packed_otherwise(session, path):
        readings.append(path)
        for name, value in zip(names, ("0", "100000", "1") if len(readings) > 1 else ("4194304", "4096", "8"), strict=True):
            session.conf.set(name, value)
        return pieces(session, path)

    before = [spark.conf.get(n, None) for n in names]
    monkeypatch.setattr(warc, "_pieces", packed_otherwise)
    try:
        assert told(read_warc(spark, f"{tmp_path}/w")) == expected(rows)
    finally:
        for name, value in zip(names, before):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(readings) == 2
