"""Strict delimited exports as datasets of text columns.

Spark's reader does the parsing. What it hides (blank lines, stray quotes, bytes
that are not UTF-8) is found by a text scan of the same files, so nothing is
dropped or repaired silently.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.functions.dataset import META_COLUMNS, SOURCE_FILE, header
from tabwarden.functions.text import strip
from tabwarden.session import written
from tabwarden.sources import records

CORRUPT = "_corrupt_record"
FORBIDDEN_DELIMITERS = ("\r", "\n", "\0", '"')


class ExportError(ValueError):
    """An export whose structure is ambiguous."""


def _check_delimiter(delimiter: str) -> None:
    if not isinstance(delimiter, str) or len(delimiter) != 1 or delimiter in FORBIDDEN_DELIMITERS:
        raise ExportError("the delimiter must be one character, no line end, NUL or double quote")


def _options(delimiter: str, multi_line: bool) -> dict[str, str | bool]:
    return {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "encoding": "UTF-8",
        "multiLine": multi_line,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "nullValue": "\0",
        "emptyValue": "",
        "comment": "",
        "maxCharsPerColumn": -1,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }


def export_header(
    spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool = True
) -> list[str]:
    """The names in the first record, as written."""
    _check_delimiter(delimiter)
    options = _options(delimiter, multi_line)
    first = spark.read.options(**options).option("header", False).csv(path).limit(1).collect()
    return [value or "" for value in first[0]] if first else []


def header_problems(headers: list[str]) -> list[tuple[str, str]]:
    """``(code, column)`` of everything wrong with one header."""
    if not headers:
        return [("no_header", "")]
    found = [("blank_header", name) for name in headers if not name.strip()]
    repeated = dict.fromkeys(name for name in headers if headers.count(name) > 1)
    return found + [("duplicate_header", name) for name in repeated]


def header_contract(headers: DataFrame) -> DataFrame:
    """Header problems of many files from rows ``(source, position, header)``.

    A file without a header has one row with a NULL header.
    """
    name = F.col("header")
    blank = F.when(name.isNull(), "no_header").when(strip(name) == "", "blank_header")
    single = headers.select("source", blank.alias("code"), F.coalesce(name, F.lit("")).alias("header"))
    single = single.filter(F.col("code").isNotNull())
    repeated = headers.filter(name.isNotNull()).groupBy("source", "header").count()
    repeated = repeated.filter("count > 1").select(
        "source", F.lit("duplicate_header").alias("code"), "header"
    )
    return single.unionByName(repeated)


def scan_export(
    spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool = True
) -> DataFrame:
    """All records as text columns, with their file, ``record_no`` and the raw
    text of records whose field count differs from the header's.

    ``multi_line`` allows line ends inside quotes but keeps a file in one task;
    turn it off for large exports without them.
    """
    headers = export_header(spark, path, delimiter, multi_line)
    problems = header_problems(headers)
    if problems:
        raise ExportError(f"header problem {problems[0][0]} {problems[0][1]!r}")
    fields = [T.StructField(name, T.StringType()) for name in headers]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).options(**_options(delimiter, multi_line))
    # Every file must have the same header; Spark compares names when told to.
    rows = reader.option("header", True).option("enforceSchema", False).csv(path)
    return _number_by_block(rows, [*headers, CORRUPT])


def scan_export_lines(
    spark: SparkSession, path: str, headers: list[str], delimiter: str = ","
) -> DataFrame:
    """Like :func:`scan_export` for one export split over many files, of which
    only one starts with the header line; that line is left out."""
    _check_delimiter(delimiter)
    problems = header_problems(headers)
    if problems:
        raise ExportError(f"header problem {problems[0][0]} {problems[0][1]!r}")
    fields = [T.StructField(name, T.StringType()) for name in headers]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(schema).options(**_options(delimiter, False)).csv(path)
    numbered = _number_by_block(rows, [*headers, CORRUPT])
    is_header = F.lit(True)
    for name in headers:
        is_header = is_header & F.col(f"`{name}`").eqNullSafe(F.lit(name))
    return numbered.filter(~is_header)


def _number_by_block(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Record numbers per file, from 2, without sorting or a single task.

    Rows are counted per file block; the counts of earlier blocks of the file
    shift the position inside the block.
    """
    block = ["__path", "__start"]
    # Spark refuses to read the raw text of a record without any field beside it.
    data = [name for name in columns if name != CORRUPT]
    beside = F.coalesce(F.length(F.col(f"`{data[0]}`")), F.lit(0)) >= 0
    placed = rows.select(
        *[F.col(f"`{name}`") for name in data],
        F.when(beside, F.col(CORRUPT)).alias(CORRUPT),
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = placed.groupBy(*block).agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    earlier = Window.partitionBy("__path").orderBy("__start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.select(
        *block, "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")
    )
    number = F.col("__id") - F.col("__first") + F.col("__before") + 2
    return placed.join(blocks, block).select(
        F.col("__path").alias(SOURCE_FILE),
        number.cast("bigint").alias("record_no"),
        *[F.col(f"`{name}`") for name in columns],
    )


def with_record_no(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Record numbers of a table: from a dense 0-based key, else from the place
    of each row in its Parquet file."""
    place = F.col(order_col) if order_col else F.col("_metadata.row_index")
    return df.select((place + 2).cast("bigint").alias("record_no"), "*")


def structure_quarantine(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split scanned records into good ones and ones of the wrong width.

    Absent values of good records become blank text.
    """
    names = [name for name in header(scanned) if name != CORRUPT]
    cells = [F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) for name in names]
    good = scanned.filter(F.col(CORRUPT).isNull()).select(*META_COLUMNS, *cells)
    bad = scanned.filter(F.col(CORRUPT).isNotNull())
    return good, bad.select(*META_COLUMNS, F.col(CORRUPT).alias("raw"))


def structure_checks(
    spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool = True
) -> DataFrame:
    """Violations the parser would hide, as ``(source, check, violations)``."""
    _check_delimiter(delimiter)
    text = spark.read.text(path, wholetext=multi_line)
    sep = "\\" + delimiter if not delimiter.isalnum() else delimiter
    quoted = rf'(?<=^|[{sep}\r\n\x{{FEFF}}])"[^"]*+(?:""[^"]*+)*+"(?=[{sep}\r\n]|\z)'
    plain = F.regexp_replace("value", quoted, F.lit("q"))
    stray = F.size(F.regexp_extract_all(plain, F.lit(rf'((?:^|[{sep}\r\n\x{{FEFF}}])")'), 1))
    if multi_line:
        blank = F.size(F.regexp_extract_all(plain, F.lit(r"(?m)(^\r?$)(?!\z)"), 1))
    else:
        blank = F.when(F.col("value").isin("", "\r"), 1).otherwise(0)
    checks = {
        "not_utf8": F.when(F.is_valid_utf8("value"), 0).otherwise(1),
        "stray_quote": stray,
        "blank_line": blank,
    }
    source = F.col("_metadata.file_path").alias("source")
    counted = text.select(source, *[column.alias(name) for name, column in checks.items()])
    totals = counted.groupBy("source").agg(*[F.sum(name).alias(name) for name in checks])
    entries = F.array(
        *[F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in checks]
    )
    return totals.select("source", F.explode(entries).alias("e")).select("source", "e.*")


def read_export(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    multi_line: bool = True,
    strict: bool = True,
) -> DataFrame:
    """An export as a dataset. Strict reading raises on any structural problem, and
    names the first record that has one; otherwise bad records are left for
    :func:`structure_quarantine`.

    With ``multi_line``, line ends in quotes belong to the record, and files are still
    read in splits; see :mod:`tabwarden.sources.records`. Strict reading passes over
    such files twice and writes their records.
    """
    if multi_line:
        return _read_records(spark, path, delimiter, strict)
    good, bad = structure_quarantine(scan_export(spark, path, delimiter, multi_line))
    if strict:
        checks = structure_checks(spark, path, delimiter, multi_line)
        failed = checks.filter("violations > 0").agg(F.min_by(F.struct("source", "check"), F.struct("source", "check")).alias("first"))
        if (first := failed.first().first) is not None:
            raise ExportError(f"structure check failed: {first.check}")
        wrong = bad.agg(F.min(F.struct(SOURCE_FILE, "record_no")).alias("first")).first().first
        if wrong is not None:
            raise ExportError(f"{wrong[SOURCE_FILE]}, record {wrong.record_no}: wrong field count")
    return good


def _read_records(spark: SparkSession, path: str, delimiter: str, strict: bool) -> DataFrame:
    headers = export_header(spark, path, delimiter)
    problems = header_problems(headers)
    if problems:
        raise ExportError(f"header problem {problems[0][0]} {problems[0][1]!r}")
    found = records.records(spark, path, delimiter)
    parsed = records.parsed(found, headers, delimiter, _options(delimiter, True))
    names = [F.col(f"`{name}`") for name in headers]
    if strict:
        parsed = written(parsed, "records")
        broken = parsed.filter(F.col(records.PROBLEM).isNotNull() | F.col(CORRUPT).isNotNull())
        first = broken.agg(F.min(F.struct(SOURCE_FILE, "record_no", F.col(records.PROBLEM).isNull(), records.PROBLEM)).alias("first")).first().first
        if first is not None and first[records.PROBLEM] is not None:
            raise ExportError(f"structure check failed: {first[records.PROBLEM]} ({first[SOURCE_FILE]}, record {first.record_no})")
        if first is not None:
            raise ExportError(f"{first[SOURCE_FILE]}, record {first.record_no}: wrong field count")
    kept = parsed.filter(~F.col(records.IS_HEADER) & (F.coalesce(F.col(records.PROBLEM), F.lit("")) != "blank_line"))
    good, _ = structure_quarantine(kept.select(*META_COLUMNS, *names, CORRUPT))
    return good


def volume_guard(
    df: DataFrame, max_rows: int, lengths: DataFrame | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Size limits as expectations: one row per check, observed and limit.

    ``lengths`` has one row per file with its ``length``.
    """

    def outcome(counted: DataFrame, check: str, limit: int) -> DataFrame:
        observed = F.col("observed")
        return counted.select(
            F.lit(check).alias("check"),
            observed.alias("observed"),
            F.lit(limit).cast("bigint").alias("limit"),
            F.when(observed > limit, 1).otherwise(0).cast("bigint").alias("violations"),
        )

    result = outcome(df.agg(F.count(F.lit(1)).alias("observed")), "max_rows", max_rows)
    if lengths is not None and max_bytes is not None:
        largest = lengths.agg(F.coalesce(F.max("length"), F.lit(0)).cast("bigint").alias("observed"))
        result = result.unionByName(outcome(largest, "max_bytes", max_bytes))
    return result


def checks_passed(checks: DataFrame, names: Iterable[str] = ()) -> bool:
    """Whether no listed check (all, if none is listed) has a violation."""
    wanted = list(names)
    failed = checks.filter("violations > 0")
    if wanted:
        failed = failed.filter(F.col("check").isin(wanted))
    return failed.isEmpty()
