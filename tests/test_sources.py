from __future__ import annotations

from datetime import datetime
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from patronlens.operators.cleaning import clean_lines
from patronlens.schemas import LINE_COLUMNS
from patronlens.sources import csv_lines, stages
from patronlens.sources.csv_lines import malformed_fields, read_lines_csv, union_sources
from patronlens.plans.pipelines import followed_rfm
from patronlens.functions.running import running_totals
from patronlens.sources import parts
from patronlens.sources.exports import write_csv_chunks, write_ordered_chunks, write_report_csv

HEADER = ",".join(LINE_COLUMNS)


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")


def test_csv_parts_with_awkward_text(spark, tmp_path):
    write(tmp_path / "lines_part1.csv", '536365,85123A,"A ""big"", white mug",6,2010-12-01 08:26:00,2.55,13085.0,France')
    write(
        tmp_path / "lines_part2.csv",
        "C536366,NA,n/a,-1,2010-12-02 09:00:30.5,NaN,,null",
        "536367,10,café,1,2010-12-02 09:00:00,1.5,NA,Österreich",
    )
    rows = {r["InvoiceNo"]: r for r in read_lines_csv(spark, str(tmp_path / "lines_part*.csv")).collect()}
    first = rows["536365"]
    assert first["Description"] == 'A "big", white mug' and first["CustomerID"] == 13085.0
    assert first["InvoiceDate"] == datetime(2010, 12, 1, 8, 26) and first["Country"] == "France"
    second = rows["C536366"]
    assert second["StockCode"] is None and second["Description"] is None and second["Country"] is None
    assert second["CustomerID"] is None and second["InvoiceDate"] == datetime(2010, 12, 2, 9, 0, 30, 500000)
    assert rows["536367"]["CustomerID"] is None and rows["536367"]["Description"] == "café"
    clean = clean_lines(read_lines_csv(spark, str(tmp_path / "lines_part*.csv"))).collect()
    assert [(r["CustomerID"], r["TotalPrice"]) for r in clean] == [(13085, pytest.approx(15.3))]


def test_line_breaks_and_other_date_forms(spark, tmp_path):
    write(tmp_path / "a.csv", '1,A,"two\nlines",6,12/01/2010 08:26,2.55,1,France')
    lines = read_lines_csv(spark, str(tmp_path / "a.csv"), multi_line=True, timestamp_format="MM/dd/yyyy HH:mm")
    (row,) = lines.collect()
    assert row["Description"] == "two\nlines" and row["InvoiceDate"] == datetime(2010, 12, 1, 8, 26)


def test_broken_records_over_split_borders(spark, tmp_path):
    import csv
    import gzip
    import io
    import random

    draw = random.Random(7)
    bits = ["a", "mug, red", 'say "hi"', "two\nlines", "\n", '"', ",", "x" * 40, '\n"\n', "ends\n"]
    expected = []
    for part in range(4):
        names = list(LINE_COLUMNS)
        if part == 1:
            names = [*reversed(names), "Extra"]
        text = io.StringIO()
        writer = csv.writer(text, lineterminator="\r\n" if part == 2 else "\n")
        writer.writerow(names)
        for i in range(60):
            words = "t" + "".join(draw.choice(bits) for _ in range(draw.randrange(1, 9))) + "t"
            if part == 3 and i % 10 == 0:
                words = "t" + "long\n" * 90 + "t"
            row = dict(zip(LINE_COLUMNS, [f"{part}-{i}", "A", words, "6", "2010-12-01 08:26:00", "2.5", "1", "France"]))
            writer.writerow([row.get(n, "more") for n in names])
            expected.append((f"{part}-{i}", words))
        data = text.getvalue()
        if part == 0:
            # A quote inside a field that is not quoted stands for itself, blank lines for nothing.
            data += '0-x,A,5" pipe,1,2010-12-01 08:26:00,2.5,1,France\n\n0-y,A,6" "pipe",1,2010-12-01 08:26:00,2.5,1,France\n'
            expected += [("0-x", '5" pipe'), ("0-y", '6" "pipe"')]
        if part == 3:
            (tmp_path / f"{part}.csv.gz").write_bytes(gzip.compress(data.encode()))
        else:
            (tmp_path / f"{part}.csv").write_bytes(data.encode())
    (tmp_path / "empty.csv").write_text("")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("150b", "1k", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            lines = read_lines_csv(spark, str(tmp_path), multi_line=True)
            found = [(r["InvoiceNo"], r["Description"]) for r in lines.select("InvoiceNo", "Description", "Quantity").collect()]
            blocks = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert sorted(found) == sorted(expected)
        assert blocks > 20 or split != "150b"
    assert malformed_fields(spark, str(tmp_path), multi_line=True).agg(F.sum("fields")).first()[0] == 0
    (tmp_path / "cut.csv").write_text(HEADER + '\n1,A,"never\nclosed,6\n')
    with pytest.raises(Exception, match="not a line of the table"):
        read_lines_csv(spark, str(tmp_path / "cut.csv"), multi_line=True).collect()


def test_headers_come_in_one_job(spark, tmp_path, monkeypatch):
    from patronlens.sources import csv_lines

    monkeypatch.setattr(csv_lines, "_first_line", None)
    for i in range(40):
        names = LINE_COLUMNS[i % 3:] + LINE_COLUMNS[:i % 3]
        row = dict(zip(LINE_COLUMNS, [str(i), HEADER.replace(",", " "), "x", "6", "2010-12-01 08:26:00", "2.5", "1", "France"]))
        (tmp_path / f"{i}.csv").write_text(("\ufeff" if i % 2 else "") + ",".join(f'"{n}"' for n in names) + "\n" + ",".join(row[n] for n in names) + "\n")
    lines = read_lines_csv(spark, str(tmp_path))
    assert sorted(int(r["InvoiceNo"]) for r in lines.collect()) == list(range(40))


def test_missing_parts_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no line files match"):
        read_lines_csv(spark, str(tmp_path / "lines_part*.csv"))


def test_union_renames_and_matches_by_name(spark):
    older = spark.createDataFrame([("1", 2.0, 3.0)], ["Invoice", "Price", "Customer ID"])
    newer = spark.createDataFrame([(4.0, "2", 5.0)], ["CustomerID", "InvoiceNo", "UnitPrice"])
    rows = sorted(tuple(r) for r in union_sources([older, newer]).collect())
    assert rows == [("1", 2.0, 3.0), ("2", 5.0, 4.0)]


def test_chunks_hold_every_row_within_the_size(spark, make_lines, tmp_path):
    # Long rows come last.
    rows = [{"InvoiceNo": str(i), "Description": 'a "quoted", text' * (1 if i < 700 else 12)} for i in range(900)]
    lines = make_lines(rows).coalesce(2)
    count = write_csv_chunks(lines, str(tmp_path / "chunks"), chunk_bytes=12_000)
    files = list((tmp_path / "chunks").glob("*.csv"))
    assert len(files) == count > 5
    assert all(f.stat().st_size < 12_000 * 1.05 for f in files)
    back = read_lines_csv(spark, str(tmp_path / "chunks"))
    assert back.exceptAll(lines).isEmpty() and lines.exceptAll(back).isEmpty()


def test_large_chunks_are_written_by_several_tasks(spark, tmp_path):
    # 150 MB of text; a file of 1 GB would be one task's work.
    lines = spark.range(1_500).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    count = write_csv_chunks(lines, str(tmp_path / "chunks"), chunk_bytes=1 << 30)
    files = list((tmp_path / "chunks").glob("*.csv"))
    assert len(files) == count == 2
    assert all(f.stat().st_size < 128 * 1024 * 1024 for f in files)
    back = spark.read.schema("id bigint, text string").csv(str(tmp_path / "chunks"), header=True)
    assert back.agg(F.count_distinct("id"), F.sum(F.length("text"))).first()[:] == (1_500, 150_000_000)


def test_ordered_chunks_are_contiguous_and_bounded(spark, make_lines, tmp_path):
    rows = [
        {"InvoiceNo": f"{i:05d}", "Description": "long text, quoted" * (30 if i % 97 == 0 else i % 5)} for i in range(1500)
    ] + [{"InvoiceNo": "00700", "Description": f"tie {i}"} for i in range(200)] + [{"InvoiceNo": None}] * 3
    lines = make_lines(rows).repartition(7)
    bound = 4_000
    count = write_ordered_chunks(lines, str(tmp_path / "out"), ["InvoiceNo", "Description"], chunk_bytes=bound)
    folders = sorted((tmp_path / "out").glob("chunk=*"))
    assert len(folders) == count > 20
    assert [f.name for f in folders] == [f"chunk={i:08d}" for i in range(count)]
    last = ("", "")
    for folder in folders:
        (file,) = folder.glob("*.csv")
        assert file.stat().st_size <= bound
        own = [(r["InvoiceNo"] or "", r["Description"]) for r in read_lines_csv(spark, str(file)).collect()]
        assert own == sorted(own, key=lambda r: (r[0], r[1] or "")) and (last[0], last[1] or "") <= (own[0][0], own[0][1] or "")
        last = own[-1]
    back = read_lines_csv(spark, str(tmp_path / "out"))
    blank = lines.withColumn("Description", F.expr("nullif(Description, '')"))
    assert back.count() == len(rows) and back.exceptAll(blank).isEmpty()
    with pytest.raises(ValueError, match="do not fit"):
        write_ordered_chunks(lines, str(tmp_path / "small"), ["InvoiceNo"], chunk_bytes=300)
    assert write_ordered_chunks(lines.where("false"), str(tmp_path / "none"), ["InvoiceNo"]) == 0


def test_running_totals_of_hot_and_missing_groups(spark):
    pairs = [(1, i, i % 7) for i in range(5000)] + [(None, i, 1) for i in range(50)] + [(i, 0, 2) for i in range(2, 300)]
    rows = spark.createDataFrame(pairs, "g int, o int, v int").repartition(9)
    found = {(r["g"], r["o"]): r["t"] for r in running_totals(rows, ["g", "o"], F.col("v"), "t", within=["g"]).collect()}
    sums: dict = {}
    for g, o, v in sorted(pairs, key=lambda r: (r[0] or 0, r[1])):
        assert found[g, o] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    total = 0
    whole = {(r["g"], r["o"]): r["t"] for r in running_totals(rows, ["g", "o"], F.col("v"), "t").collect()}
    for g, o, v in sorted(pairs, key=lambda r: (r[0] or 0, r[1])):
        assert whole[g, o] == total
        total += v
    assert running_totals(rows.where("false"), ["g"], F.col("v"), "t").collect() == []


def line(invoice, customer, price="2.0"):
    return f"{invoice},A,x,1,2011-01-01 00:00:00,{price},{customer},France"


def test_only_new_and_changed_parts_are_read(spark, tmp_path, monkeypatch):
    from patronlens.plans import pipelines

    folder, read = tmp_path / "parts", []
    folder.mkdir()
    reader = pipelines.read_lines_csv
    monkeypatch.setattr(pipelines, "read_lines_csv", lambda s, files, **o: (read.append(sorted(Path(f).name for f in files)), reader(s, files, **o))[1])

    def follow(**reading):
        read.clear()
        rfm, found = followed_rfm(spark, f"{folder}/*.csv", str(tmp_path / "totals"), **reading)
        rows = sorted((r["CustomerID"], r["Frequency"], r["Monetary"]) for r in rfm.collect())
        whole = pipelines.build_rfm(clean_lines(reader(spark, f"{folder}/*.csv")))
        assert rows == sorted((r["CustomerID"], r["Frequency"], r["Monetary"]) for r in whole.collect())
        return [f for files in read for f in files], (found.added, found.changed, found.removed, found.unchanged)

    write(folder / "a 1.csv", line(1, 7), line(2, 7), line(3, 8))
    write(folder / "b.csv", line(1, 7), line(4, 9))
    assert follow() == (["a 1.csv", "b.csv"], (2, 0, 0, 0))
    assert follow() == ([], (0, 0, 0, 2))
    write(folder / "c.csv", line(5, 9))
    assert follow() == (["c.csv"], (1, 0, 0, 2))
    write(folder / "b.csv", line(1, 7), line(4, 9, "3.5"), line(6, 10))
    assert follow() == (["b.csv"], (0, 1, 0, 2))
    (folder / "c.csv").unlink()
    assert follow() == ([], (0, 0, 1, 2))
    assert follow(missing_tokens=("", "NA")) == (["a 1.csv", "b.csv"], (0, 2, 0, 0))
    # A refresh that broke off before its manifest was complete changes nothing.
    newest = max((tmp_path / "totals").glob("manifest-*"))
    (newest / "_SUCCESS").rename(newest / "_GONE")
    assert parts.read_parts(spark, str(tmp_path / "totals")).count() > 0
    with pytest.raises(FileNotFoundError):
        parts.read_parts(spark, str(tmp_path / "nothing"))


def test_stages_of_a_scope_are_removed(spark):
    with stages.released() as keep:
        first = stages.stage(spark.range(5), "first")
        with stages.released() as keep_inner:
            inner = stages.stage(first.selectExpr("id * 2 AS id"), "inner")
            second = keep_inner(inner.selectExpr("id + 1 AS id"), "second")
        kept = keep(second.where("id > 1"), "kept")
        files = [f for df in (first, inner, second) for f in df.inputFiles()]
        gone, there = files[len(first.inputFiles()): len(first.inputFiles()) + len(inner.inputFiles())], first.inputFiles() + second.inputFiles()
        assert not any(Path(f.removeprefix("file://")).exists() for f in gone)
        assert all(Path(f.removeprefix("file://")).exists() for f in there)
    assert not any(Path(f.removeprefix("file://")).exists() for f in files)
    assert sorted(r["id"] for r in kept.collect()) == [3, 5, 7, 9]


def test_parts_are_read_by_their_headers(spark, tmp_path):
    write(tmp_path / "a.csv", "1,A,x,6.0,2011-01-01 00:00:00,2.5,7.0,France")
    order = ["Country", "Extra", "UnitPrice", "InvoiceDate", "CustomerID", "Quantity", "Description", "StockCode", "InvoiceNo"]
    (tmp_path / "b.csv").write_text("\ufeff" + ",".join(order) + "\nSpain,?,1.5,2011-01-02 00:00:00,8,4,y,B,2\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    lines = read_lines_csv(spark, f"{tmp_path}/*.csv")
    rows = {r["InvoiceNo"]: (r["Quantity"], r["UnitPrice"], r["CustomerID"], r["Country"]) for r in lines.collect()}
    assert rows == {"1": (6, 2.5, 7.0, "France"), "2": (4, 1.5, 8.0, "Spain")}
    assert clean_lines(lines).count() == 2
    (tmp_path / "b.csv").write_text("InvoiceNo,Quantity\n1,2\n")
    with pytest.raises(ValueError, match="StockCode"):
        read_lines_csv(spark, f"{tmp_path}/*.csv")


def test_unreadable_fields_are_never_lost_silently(spark, tmp_path):
    write(
        tmp_path / "a.csv", "1,A,x,six,2011-01-01 00:00:00,2.5,7.0,France", "2,A,x,6,01.02.2011,2.5,7.0,France",
        "3,A,x,2.5,2011-01-01 00:00:00,cheap,7.0,France", "4,A,x,1,2011-01-01 00:00:00,1.0,,France", "5,A,x",
    )
    for bad in ("Quantity: six", "InvoiceDate: 01.02.2011"):
        with pytest.raises(Exception, match=bad):
            read_lines_csv(spark, str(tmp_path / "a.csv")).where(F.col("InvoiceNo") == ("1" if "six" in bad else "2")).collect()
    counts = {r["column"]: r["fields"] for r in malformed_fields(spark, str(tmp_path / "a.csv")).collect()}
    assert {c: n for c, n in counts.items() if n} == {"Quantity": 2, "InvoiceDate": 1, "UnitPrice": 1, "(line)": 1}
    assert read_lines_csv(spark, str(tmp_path / "a.csv"), malformed="null").count() == 5


def test_report_has_a_byte_order_mark(spark, tmp_path):
    report = spark.createDataFrame([("Champions 冠军", 'a, "b"')], "Segment string, Strategy string")
    for mark, start in ((True, b"\xef\xbb\xbfSegment"), (False, b"Segment")):
        write_report_csv(report, str(tmp_path / f"report-{mark}"), byte_order_mark=mark)
        (file,) = (tmp_path / f"report-{mark}").glob("*.csv")
        text = file.read_bytes()
        assert text.startswith(start)
        assert text.decode("utf-8-sig").splitlines()[1] == 'Champions 冠军,"a, ""b"""'


def test_read_or_build_builds_once(spark, tmp_path):
    path, built = str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return spark.range(3 * len(built))

    assert stages.read_or_build(spark, path, build).count() == 3
    assert stages.read_or_build(spark, path, build).count() == 3
    assert stages.read_or_build(spark, path, build, rebuild=True).count() == 6
    assert len(built) == 2
    broken = tmp_path / "broken"
    (broken / "_temporary").mkdir(parents=True)
    assert stages.read_or_build(spark, str(broken), lambda: spark.range(2)).count() == 2
    half = tmp_path / "half"
    spark.range(1000).repartition(4).write.parquet(str(half))
    next(half.glob("part-*.parquet")).unlink()
    (half / "_SUCCESS").unlink()
    assert stages.read_or_build(spark, str(half), lambda: spark.range(1000)).count() == 1000


def test_stage_lives_in_the_shared_folder(spark):
    staged = stages.stage(spark.range(10).withColumn("x", F.col("id") * 2), "numbers")
    assert staged.agg(F.sum("x")).first()[0] == 90
    assert staged.inputFiles() and all("/patronlens/" in f and "/numbers-" in f for f in staged.inputFiles())


class Settings:
    """A session that knows only its settings."""

    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_stage_root_is_never_a_local_folder_on_a_cluster():
    assert stages.stage_root(Settings(spark_checkpoint_dir="hdfs:///stages/", spark_master="yarn")) == "hdfs:///stages"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.stage_root(Settings(spark_master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.stage_root(Settings(spark_master="yarn", spark_sql_warehouse_dir="file:/tmp/warehouse"))
    assert stages.stage_root(Settings(spark_master="yarn", spark_sql_warehouse_dir="hdfs://a/w")) == "hdfs://a/w"
    assert stages.stage_root(Settings(spark_master="local[2]", spark_sql_warehouse_dir="file:/a/w")) == "file:/a/w"


def test_no_forbidden_shortcuts_in_the_sources():
    root = Path(stages.__file__).resolve().parent.parent
    text = "\n".join(p.read_text() for p in root.rglob("*.py"))
    for word in ("localCheckpoint", "crossJoin", "toPandas", "pandas_udf", ".rdd", ".sample("):
        assert word not in text


def test_file_names_of_one_header_stay_off_the_driver(spark, tmp_path, make_lines, monkeypatch):
    names = []
    monkeypatch.setattr(csv_lines, "unquote", lambda name: names.append(name) or unquote(name))
    lines = make_lines([{"InvoiceNo": str(i), "Description": "x" * 40} for i in range(60)])
    assert write_ordered_chunks(lines, f"{tmp_path}/a", ["InvoiceNo"], chunk_bytes=1500) > 3
    back = csv_lines.read_lines_csv(spark, f"{tmp_path}/a")
    assert back.count() == back.distinct().count() == 60 and not names
    (tmp_path / "a" / "chunk=odd").mkdir()
    header = ",".join(reversed(back.columns))
    (tmp_path / "a" / "chunk=odd" / "part.csv").write_text(f"{header}\nSpain,1,2.0,2011-01-01 00:00:00,1,thing,A,z\n")
    assert csv_lines.read_lines_csv(spark, f"{tmp_path}/a").where("InvoiceNo = 'z' AND Country = 'Spain'").count() == 1
    assert len(names) > 3
