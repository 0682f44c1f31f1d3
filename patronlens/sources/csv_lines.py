"""Retail lines from CSV parts, and from yearly sources with older column names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from patronlens import schemas
from patronlens.functions.columns import blank_to_null
from patronlens.sources.stages import stage

_CORRUPT = "_corrupt_record"
_SOURCE = "_source_file"


def read_lines_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    multi_line: bool = False,
    timestamp_format: str | None = None,
    missing_tokens: Sequence[str] = tuple(schemas.MISSING_TOKENS),
    schema: T.StructType = schemas.RAW_LINES,
    malformed: str = "raise",
    source_column: str | None = None,
) -> DataFrame:
    """All CSV parts under one schema; ``paths`` may hold globs.

    ``source_column`` adds the file that a line came from, under this name.

    Columns are found by each part's own header, so parts may order them differently and
    have others besides; a missing one is an error.  Time stamps read like
    ``yyyy-MM-dd HH:mm:ss`` with an optional fraction unless ``timestamp_format`` says
    otherwise.  A whole number may be written ``6.0``.  A field that is neither missing nor
    readable stops the reading job, or becomes NULL with ``malformed="null"``; see
    ``malformed_fields`` for their number.  Set ``multi_line`` only when descriptions
    contain line breaks: such files are split between tasks too, but their lines are staged
    and shuffled once to find where records begin.  Line breaks inside fields become line feeds.
    """
    if malformed not in ("raise", "null"):
        raise ValueError(f"unknown option: {malformed!r}")
    columns = {}
    for field in schema:
        text = blank_to_null(F.col(field.name), missing_tokens)
        value = _typed(text, field, timestamp_format)
        if malformed == "raise":
            said = F.concat(F.lit(f"cannot read {field.name}: "), text)
            value = F.when(_unreadable(text, value), F.raise_error(said).cast(field.dataType)).otherwise(value)
        columns[field.name] = value.alias(field.name)
    texts = _text_parts(spark, paths, schema, multi_line)
    if source_column:
        columns[source_column] = F.col(_SOURCE).alias(source_column)
    if malformed == "raise":
        first, *_ = columns
        cut = F.concat(F.lit("not a line of the table: "), F.col(_CORRUPT))
        kind = schema[first].dataType
        columns[first] = F.when(F.col(_CORRUPT).isNotNull(), F.raise_error(cut).cast(kind)).otherwise(columns[first]).alias(first)
    return texts.select(*columns.values())


def malformed_fields(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    multi_line: bool = False,
    timestamp_format: str | None = None,
    missing_tokens: Sequence[str] = tuple(schemas.MISSING_TOKENS),
    schema: T.StructType = schemas.RAW_LINES,
) -> DataFrame:
    """``column, fields``: fields that are neither missing nor readable, and lines with too few or too many of them."""
    counts = []
    for field in schema:
        text = blank_to_null(F.col(field.name), missing_tokens)
        bad = _unreadable(text, _typed(text, field, timestamp_format))
        counts.append(F.struct(F.lit(field.name).alias("column"), F.count_if(bad).alias("fields")))
    counts.append(F.struct(F.lit("(line)").alias("column"), F.count_if(F.col(_CORRUPT).isNotNull()).alias("fields")))
    # A row of results first: Spark refuses to read the corrupt column alone.
    return _text_parts(spark, paths, schema, multi_line).agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def _typed(text: Column, field: T.StructField, timestamp_format: str | None) -> Column:
    if isinstance(field.dataType, T.StringType):
        return text
    if isinstance(field.dataType, T.IntegralType):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.cast(field.dataType))
    if isinstance(field.dataType, T.TimestampNTZType) and timestamp_format:
        return F.try_to_timestamp(text, F.lit(timestamp_format)).cast(field.dataType)
    return text.try_cast(field.dataType)


def _unreadable(text: Column, value: Column) -> Column:
    return text.isNotNull() & value.isNull()


def _text_parts(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, multi_line: bool) -> DataFrame:
    """The schema's columns as text, and the lines that do not fit their header."""
    try:
        texts = spark.read.text([paths] if isinstance(paths, str) else list(paths))
        found = len(texts._jdf.inputFiles()) > 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = False
    if not found:
        raise FileNotFoundError(
            f"no line files match {paths!r}: put the CSV parts there, or export them with "
            "patronlens.sources.exports.write_csv_chunks"
        )
    lines = texts.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value",
    )
    if multi_line:
        lines = stage(lines, "csv-lines")
    headers = stage(_headers(lines, schema), "headers")
    for row in headers.where(F.col("header").isNull()).limit(1).collect():
        names = _names(_first_line(spark, unquote(row["file"])))
        missing = [c for c in schema.fieldNames() if c not in names]
        raise ValueError(f"{row['file']} has no column {', '.join(missing)}")
    by_header = [row["header"] for row in headers.select("header").distinct().collect()]
    wanted = [*schema.fieldNames(), _CORRUPT, _SOURCE]
    records = _records(lines) if multi_line else None
    parts = []
    for header in by_header:
        shape = T.StructType([T.StructField(n, T.StringType()) for n in [*_names(header), _CORRUPT]])
        options = {"escape": '"', "columnNameOfCorruptRecord": _CORRUPT}
        if multi_line:
            ours = records if len(by_header) == 1 else records.join(headers.where(F.col("header") == header), "file", "left_semi")
            row = F.from_csv("value", F.lit(shape.toDDL()), options)
            part = ours.select(row.alias("row"), F.col("file").alias(_SOURCE)).select("row.*", _SOURCE)
        else:
            reader = spark.read.schema(shape).options(header=True, enforceSchema=True, **options)
            # Names of files reach the driver only where headers differ.
            own = [paths] if isinstance(paths, str) else list(paths)
            if len(by_header) > 1:
                own = [unquote(row["file"]) for row in headers.where(F.col("header") == header).select("file").collect()]
            part = reader.csv(own).withColumn(_SOURCE, F.col("_metadata.file_path"))
        parts.append(part.select(*wanted))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in wanted]))
    return reduce(DataFrame.unionByName, parts)


def _headers(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``file, header``: each part's first line, NULL where a column of the schema is not in it.

    One job for all parts.  Lines are aggregated as they are read: a part hands on the hash of its
    first line and the lines that name every column, of which one has that hash.
    """
    value = F.col("value")
    named = reduce(Column.__and__, [F.contains(value, F.lit(name)) for name in schema.fieldNames()])
    first = lines.where(F.col("block") == 0).groupBy("file").agg(
        F.min_by(F.xxhash64("value"), "place").alias("first"), F.collect_set(F.when(named, value)).alias("named")
    )
    header = F.get(F.filter("named", lambda line: F.xxhash64(line) == F.col("first")), F.lit(0))
    bare = F.split(F.regexp_replace("header", "^\ufeff", ""), ",")
    names = F.transform(bare, lambda name: F.btrim(F.btrim(name), F.lit('"')))
    fits = F.size(F.array_except(F.array(*map(F.lit, schema.fieldNames())), names)) == 0
    return first.select("file", header.alias("header")).withColumn("header", F.when(fits, F.col("header")))


# A line that ends inside a quoted field, if it does not begin in one: whole fields, then an open one.
_OPEN = r'^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+$'


def _scanned(rows: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Rows with what those before them in their group do to the quote state.

    Every row maps the state before it (inside a quoted field or not) to the one after it: ``out`` is
    what becomes of outside, ``in`` of inside.  Of the rows before, the last that maps both to one
    state gives ``known``, turned round by the turning rows behind it; NULL if there is none, and then
    the group's first state, turned round if ``turned``, stands before the row.
    """
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("out") & ~F.col("in")).cast("int")
    fixed = F.when(F.col("out") == F.col("in"), F.col("out").cast("int"))
    count = F.coalesce(F.sum(turns).over(before), F.lit(0))
    rows = rows.withColumn("count ", count).withColumn("fixed ", (fixed + F.col("count ") + turns) % 2)
    known = (F.last("fixed ", ignorenulls=True).over(before) + F.col("count ")) % 2 == 1
    return rows.withColumns({"known": known, "turned": F.col("count ") % 2 == 1}).drop("count ", "fixed ")


def _records(lines: DataFrame) -> DataFrame:
    """``file, value``: the records below the headers of all parts, whole where quoted fields hold line breaks.

    Each split of a part is scanned for both quote states that it may begin in; a window over one row a
    split finds which it is.  So the tasks follow the splits, not the parts.  Lines that are records
    stay as they are; only those of broken records are brought together, by their record.
    """
    ends = {"out": F.rlike("value", F.lit(_OPEN)), "in": F.rlike(F.concat(F.lit('"'), F.col("value")), F.lit(_OPEN))}
    split = ["file", "block"]
    scanned = stage(_scanned(lines.withColumns(ends), split, "place"), "csv-lines")

    def after(end: str, first: bool) -> Column:
        state = F.coalesce(F.col("known"), F.col("turned") != F.lit(first))
        return F.max_by(F.when(state, F.col("in")).otherwise(F.col("out")), "place").alias(end)

    splits = scanned.groupBy(*split).agg(after("out", False), after("in", True))
    start = F.coalesce(F.col("known"), F.col("turned"))
    splits = _scanned(splits, ["file"], "block").select(*split, start.alias("start"))
    firsts = scanned.where(F.col("block") == 0).groupBy("file").agg(F.min("place").alias("first"))
    inside = F.coalesce(F.col("known"), F.col("turned") != F.col("start"))
    told = scanned.join(splits, split).join(firsts, "file").where((F.col("block") != 0) | (F.col("place") != F.col("first")))
    told = told.withColumn("inside", inside).select(*split, "place", "value", "inside", "out")
    whole = told.where(~F.col("inside") & ~F.col("out") & (F.trim("value") != "")).select("file", "value")
    # Lines of broken records: each belongs to the last line before it that begins one, in this split or an earlier one.
    broken = stage(told.where(F.col("inside") | F.col("out")), "csv-lines")
    begins = F.when(~F.col("inside"), F.struct("block", "place"))
    own = Window.partitionBy(*split).orderBy("place")
    broken = broken.withColumn("head", F.last(begins, ignorenulls=True).over(own))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = broken.groupBy(*split).agg(F.max_by("head", "place").alias("head"))
    heads = heads.select(*split, F.last("head", ignorenulls=True).over(earlier).alias("earlier"))
    broken = broken.join(heads, split).withColumn("head", F.coalesce("head", "earlier"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "place", "value")))
    joined = broken.groupBy("file", "head").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined.select("file", "value"))


def _first_line(spark: SparkSession, file: str) -> str:
    return spark.read.text(file).first()[0]


def _names(header: str) -> tuple[str, ...]:
    """Column names of a header line."""
    names = [name.strip().strip('"') for name in header.lstrip("﻿").split(",")]
    # A name that comes twice, or none at all, is given one that no schema has.
    return tuple(n if n and names.index(n) == i else f"_column_{i}" for i, n in enumerate(names))


def union_sources(sources: Sequence[DataFrame], renames: dict[str, str] | None = None) -> DataFrame:
    """Stack sources by column name after renaming older column names."""
    renames = schemas.LEGACY_NAMES if renames is None else renames
    frames = [s.withColumnsRenamed(renames) for s in sources]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked
