"""Delimited text: scan, compressed files, record checks, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.model import MAX_LINE_BYTES, MAX_TEXT, CsvOptions, check_name, require
from itemloom.runtime import scratch_path
from itemloom.sources.narrow import apply_null_tokens, select_fields
from itemloom.sources.streams import stream_lines

CORRUPT = "_corrupt_record"


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files below a path by name, as the reader of texts finds them."""
    return sorted(spark.read.text(path).inputFiles())


def unzip(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """Unpack the first entry of each zip file into a scratch folder of text; returns the folder.

    A zip has no split points, so each file is one task that inflates it as a stream; files run in
    parallel.  A line over the size of a record fails the job.
    """
    target = scratch_path(spark, "unzipped")
    read = stream_lines(spark, files_of(spark, path), "zip", encoding)
    # the file name has to stay apart from its content: every file has a header
    read.select(F.md5("file").alias("file"), "line").write.partitionBy("file").text(target)
    return target


def _located(spark: SparkSession, path: str, options: CsvOptions) -> tuple[str, str]:
    # gzip and bzip2 are recognised by their extension
    require(
        options.compression in (None, "zip", "gzip", "bzip2"),
        f"unknown compression {options.compression}",
    )
    if options.compression == "zip":
        return unzip(spark, path, options.encoding), "UTF-8"
    return path, options.encoding


def csv_header(spark: SparkSession, path: str, options: CsvOptions) -> list[str]:
    """Column names: the first line that is not blank, trimmed."""
    first = _reader(spark, options, options.encoding).option("header", True).csv(path)
    return [name.strip() for name in first.columns]


def _reader(spark: SparkSession, options: CsvOptions, encoding: str):
    return (
        spark.read.option("sep", options.separator)
        .option("encoding", encoding)
        .option("quote", options.quote)
        .option("escape", options.escape)
        .option("multiLine", options.multi_line)
        .option("recursiveFileLookup", options.compression == "zip")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("inferSchema", False)
        .option("enforceSchema", True)
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .option("maxCharsPerColumn", MAX_LINE_BYTES)
    )


def _text(column: str):
    # a line break inside quotes counts as one blank, blanks around it are dropped
    joined = F.regexp_replace(F.col(f"`{column}`"), r"[ \t]*(\r\n|\r|\n)[ \t]*", " ")
    return F.coalesce(F.trim(joined), F.lit("")).alias(column)


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions(), mode: str = "FAILFAST") -> DataFrame:
    """Cells as trimmed text, empty cells as empty text.

    ``null_values`` of the options become missing cells, and columns without a type are left out.
    ``mode`` decides what a record with a wrong number of values does:
    ``FAILFAST`` stops the job, ``PERMISSIVE`` keeps it with its source text in
    ``_corrupt_record`` for :func:`check_records`.
    """
    source, encoding = _located(spark, path, options)
    names = csv_header(spark, source, CsvOptions(**{**options.__dict__, "encoding": encoding}))
    for name in names:
        check_name(name)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = _reader(spark, options, encoding).option("header", True).option("mode", mode)
    if mode != "PERMISSIVE":
        return _chosen(reader.schema(schema).csv(source).select(*[_text(n) for n in names]), options)
    schema = schema.add(CORRUPT, T.StringType())
    rows = reader.option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(source)
    return _chosen(rows.select(*[_text(n) for n in names], F.col(CORRUPT)), options)


def _chosen(cells: DataFrame, options: CsvOptions) -> DataFrame:
    names = [c for c in cells.columns if c != CORRUPT]
    if options.null_values:
        cells = apply_null_tokens(cells, sorted(options.null_values), names)
    if options.types is None:
        return cells
    kept, _ = select_fields(cells.select(*[F.col(f"`{n}`") for n in names]), options.types)
    return cells.select(*[F.col(f"`{c}`") for c in cells.columns if c in kept.columns or c == CORRUPT])


def check_records(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejected ones with an ``errors`` array.

    Checks: number of values, cell width, record length.  One narrow pass each.
    """
    has_corrupt = CORRUPT in df.columns
    names = [c for c in (columns or df.columns) if c != CORRUPT]
    require(len(names) > 0, "at least one field is needed")
    for name in names:
        check_name(name)
    cells = [F.col(f"`{c}`").cast("string") for c in names]
    too_wide = [F.coalesce(F.length(c) > MAX_TEXT, F.lit(False)) for c in cells]
    wide = too_wide[0]
    for flag in too_wide[1:]:
        wide = wide | flag
    length = F.octet_length(F.concat_ws(",", *cells))
    flags = [
        F.when(wide, F.lit("cell too long")),
        F.when(length > MAX_LINE_BYTES, F.lit("record too long")),
    ]
    if has_corrupt:
        flags.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("wrong number of values")))
    checked = df.withColumn("errors", F.array_compact(F.array(*flags)))
    ok = F.size("errors") == 0
    return checked.where(ok).drop("errors", CORRUPT), checked.where(~ok)


def preview(
    spark: SparkSession,
    path: str,
    lines: int,
    max_bytes: int = MAX_LINE_BYTES,
    compression: str | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """The first ``lines`` lines of a text; a line over its share of ``max_bytes`` is an error.

    Several files follow each other by name, and only as many are read as it takes.  A file is
    inflated as it is read and no further than the preview goes, so at most ``max_bytes`` are held
    and reach the driver, even from a file that is one line without an end.
    """
    require(lines > 0, "at least one line is needed")
    require(lines <= max_bytes, "a line needs at least one byte")
    found: list[str] = []
    for file in files_of(spark, path):
        head = stream_lines(spark, [file], compression, encoding, max_bytes // lines, lines - len(found))
        found += [r["line"] for r in head.orderBy("number").collect()]
        if len(found) == lines:
            break
    return spark.createDataFrame([(line,) for line in found], "line string")
