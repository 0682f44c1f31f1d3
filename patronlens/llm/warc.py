"""WARC archives written and read by Spark, with record boundaries verified as chains.

Writing: one record per page.  Of pages with the same payload the one with the largest
id is stored as a response, the others as revisits that refer to it and carry no payload.

Reading: archives of any size are split between tasks.  A task takes every occurrence
of the version line as a candidate record, works out from its headers where the next
record must begin, and emits (offset, successor).  Payloads may hold the version line
too, so candidates prove nothing by themselves: pointer jumping from the start of each
file marks what the chain of successors really reaches, in a number of rounds that grows
with the logarithm of the records in a file.  The rest is payload, and goes back into
the record it was cut from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patronlens.functions.running import running_totals
from patronlens.sources.stages import new_stage_path, stage

_MAGIC = "WARC/1.1\r\n"
_BREAK = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32_OF_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: eight groups of 20 bits, each four digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _BASE32_OF_CONV, _BASE32)


def _one_line(text: Column) -> Column:
    """A header value: control characters and spaces as percent codes, null as empty."""
    clean = F.coalesce(text, F.lit(""))
    for code in ("\r", "\n", "\t", " "):
        clean = F.replace(clean, F.lit(code), F.lit(f"%{ord(code):02X}"))
    return F.regexp_replace(clean, r"[\x00-\x1F\x7F]", "")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    Payloads of at least ``min_bytes`` are stored once, by the largest page id; every row with that id is
    a response.  Null ids are smaller than any other; if nothing else has the payload they are responses.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    holders = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and holder is not null")
        .drop("copies")
    )
    # Written first, so that the planner knows how few they are and moves no payloads if they fit a broadcast.
    marked = rows.join(stage(holders, "copied-payloads"), ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("holder") != F.coalesce("page_id", F.col("holder") - 1), F.lit(False))
    return marked.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("holder"))
    ).drop("holder")


def _record(date: str) -> Column:
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_BREAK),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    length = F.octet_length(http) + F.octet_length(body)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    return F.concat(
        F.lit(_MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "),
        length.cast("string"),
        F.lit(_BREAK),
        http,
        body,
    )


def write_warc(marked: DataFrame, path: str, *, date: str = "2000-01-01T00:00:00Z") -> None:
    """One archive per partition of ``marked``; the line break pair after a record is the writer's."""
    marked.select(_record(date).alias("value")).write.option("lineSep", _BREAK).text(path)


def _header(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _parsed(pieces: DataFrame) -> DataFrame:
    """WARC and HTTP headers, payload facts and length of the record that each piece (``body``) begins."""
    head = F.substring_index("body", _BREAK, 1)
    with_head = pieces.withColumn("head", head)
    size = _header("Content-Length")
    whole = F.contains("body", F.lit(_BREAK)) & size.rlike(r"^\d{1,18}$")
    with_head = with_head.withColumn("block_length", F.when(whole, size.cast("long")))
    data = F.col("body").cast("binary")
    begin = F.octet_length("head") + len(_BREAK)
    with_head = with_head.withColumn("length", F.lit(len(_MAGIC)) + begin + F.col("block_length") + len(_BREAK))
    block = F.substring(data, begin + 1, F.least(F.col("block_length"), F.lit(2**31 - 1)).cast("int"))
    http = F.substring_index(block.cast("string"), _BREAK, 1)
    payload = F.substring(block, F.octet_length(http) + len(_BREAK) + 1, F.lit(2**31 - 1))
    revisit = _header("WARC-Type") == "revisit"
    told = F.regexp_extract(http, r"(?i)(?:^|\r\n)Content-Length:[ \t]*(\d+)", 1)
    page = r"^<urn:page:(-?\d+)>$"
    return with_head.select(
        *[c for c in pieces.columns if c != "body"],
        "length",
        F.regexp_extract(_header("WARC-Record-ID"), page, 1).alias("page_id"),
        _header("WARC-Target-URI").alias("url"),
        _header("WARC-Type").alias("record_type"),
        F.regexp_extract(_header("WARC-Refers-To"), page, 1).alias("refers_to"),
        F.regexp_extract(_header("WARC-Payload-Digest"), r"^sha1:([A-Z2-7]+)$", 1).alias("told_digest"),
        F.when(revisit, told.cast("long")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(~revisit, base32_sha1(payload)).alias("own_digest"),
    )


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands before, between and after version lines, in order within each split of each file."""
    lines = spark.read.option("lineSep", _MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("body"),
    )


def reachable(links: DataFrame) -> DataFrame:
    """``file, offset`` of all candidates that the chain from offset 0 of their file reaches.

    Pointer jumping: ``known`` is what 2**i steps reach, ``jump`` leads 2**i steps on.
    """
    known = links.where("offset = 0").select("file", "offset")
    jump = links.where("successor > offset").select("file", "offset", "successor")
    reached = 0
    while True:
        ahead = known.join(jump, ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        ahead = ahead.join(links.select("file", "offset"), ["file", "offset"], "left_semi")
        known = stage(known.unionByName(ahead).distinct(), "reached")
        count = known.count()
        if count == reached:
            return known
        reached = count
        second = jump.select("file", F.col("offset").alias("successor"), F.col("successor").alias("after"))
        jump = stage(jump.join(second, ["file", "successor"]).select("file", "offset", F.col("after").alias("successor")), "jumps")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    Raises if a file has bytes that its chain of records does not account for, if a record of the chain
    cannot be read back, or if a payload does not have its record's digest.  Archives without records,
    or no archives' bytes at all, give no rows.
    """
    pieces = _pieces(spark, path).withColumns({"bytes": F.octet_length("body").cast("long"), "piece": F.md5(F.col("body").cast("binary"))})
    seen = _parsed(pieces)
    seen = stage(seen, "candidates")
    # Every byte of a file is in one piece, so lengths before a piece give its offset.
    within = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("bytes") + len(_MAGIC)
    splits = seen.groupBy("file", "split").agg(F.sum(step).alias("held"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    # A piece begins after a version line; its record begins with that line.  The first piece is empty.
    placed = seen.join(bases, ["file", "split"]).withColumn("end", F.col("base") + F.sum(step).over(within) - len(_MAGIC))
    placed = placed.withColumn("offset", F.col("end") - F.col("bytes") - len(_MAGIC))
    placed = placed.withColumn("successor", F.col("offset") + F.col("length"))
    placed = stage(placed, "placed")
    real = placed.where("offset >= 0")
    known = reachable(real.select("file", "offset", "successor"))
    records = stage(real.join(known, ["file", "offset"]), "records")
    ends = placed.groupBy("file").agg(F.max("end").alias("size"))
    chain = records.groupBy("file").agg(F.max(F.coalesce("successor", F.lit(-1))).alias("told"), F.count_if(F.col("length").isNull()).alias("broken"))
    wrong = ends.join(chain, "file", "left").where("size > 0 and (told is null or told != size or broken > 0)").select("file").head(1)
    if wrong:
        raise ValueError(f"the records of {wrong[0]['file']} do not fill it")

    whole = records.where("successor = end")
    cut = records.where("successor != end")
    n_cut = cut.count()
    if n_cut:
        again = stage(_reassembled(spark, path, placed, cut).select(whole.columns), "reassembled")
        if again.count() != n_cut:
            raise ValueError(f"{again.count()} of {n_cut} records with version lines in their payloads were put together again")
        whole = whole.unionByName(again)
    digest = F.coalesce("own_digest", "told_digest")
    if not whole.where("own_digest is not null and told_digest != '' and own_digest != told_digest").isEmpty():
        raise ValueError("a payload does not have the digest of its record")
    return whole.select(
        F.expr("try_cast(nullif(page_id, '') as long)").alias("page_id"), "url", "payload_bytes", digest.alias("payload_digest"),
        "record_type", F.expr("try_cast(nullif(refers_to, '') as long)").alias("refers_to"),
    )


def _reassembled(spark: SparkSession, path: str, placed: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds version lines, put together from their pieces and parsed again.

    The archives are read a second time for these pieces.  A piece is known by its file and
    bytes (their MD5), not by where Spark's splits put it, so the second reading may be split in
    another way; equal pieces of a file are interchangeable.
    """
    starts = cut.select("file", "offset", F.col("offset").alias("record"), "successor")
    every = placed.where("offset >= 0").select("file", "offset", "piece")
    concerned = every.join(starts.select("file").distinct(), "file", "left_semi")
    marks = concerned.join(starts.select("file", "offset", F.lit(1).alias("begins")), ["file", "offset"], "left")
    begins = F.coalesce("begins", F.lit(0))
    # The number of records begun so far tells a piece's record, if that has not ended.
    numbered = running_totals(marks, ["file", "offset"], begins, "number", within=["file"]).withColumn("number", F.col("number") + begins)
    records = numbered.where("begins = 1").select("file", "number", F.col("offset").alias("record"))
    owned = numbered.join(records, ["file", "number"]).join(starts.select("file", "record", "successor"), ["file", "record"])
    owned = stage(owned.where("offset < successor").select("file", "record", "offset", "piece"), "owned")
    bodies = _pieces(spark, path).select("file", "body", F.md5(F.col("body").cast("binary")).alias("piece"))
    bodies = bodies.join(owned.select("file", "piece").distinct(), ["file", "piece"], "left_semi").dropDuplicates(["file", "piece"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "body"))), lambda part: part["body"])
    joined = owned.join(bodies, ["file", "piece"]).groupBy("file", "record").agg(F.array_join(parts, _MAGIC).alias("body"))
    joined = joined.withColumnRenamed("record", "offset").withColumn("bytes", F.octet_length("body").cast("long"))
    kept = cut.select("file", "offset", "split", "place", "piece", "base", "end", "successor")
    return _parsed(joined).join(kept, ["file", "offset"])


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives below the checkpoint folder and read them back.

    A null html is an empty payload; equal rows are records of their own.
    """
    spark = pages.sparkSession
    path = new_stage_path(spark, "warc")
    write_warc(mark_revisits(pages, min_bytes), path)
    return read_warc(spark, path)
