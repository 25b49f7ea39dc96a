"""Records of delimited exports whose quotes may hold line ends, from split files.

Where a record ends depends on whether its line is inside quotes, and that on all
lines before. A line is a function of that state: it tells where it ends if it is
entered outside quotes, and if inside. Two passes make the states known everywhere
without reading a file in one task:

1. Every block of a file (a split of the text scan) works out for both entry states in
   which state it ends and how many records end in it. These few numbers for each
   block are composed along the file.
2. Every block is read again, now with its entry state and the number of records
   before it. Lines that are whole records stay as they are; only the lines of records
   of more than one line are brought together.

Records end with LF or CR LF. A quote opens a field only at its start, as in the
parser; other quotes are text there, and reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.functions.dataset import SOURCE_FILE
from tabwarden.session import written

PROBLEM = "__problem"
IS_HEADER = "__is_header"
#: Of a block: file and place in it.
_BLOCK = ["path", "start"]


def _separator(delimiter: str) -> str:
    return "\\" + delimiter if not delimiter.isalnum() else delimiter


def _without_quoted(text: Column, sep: str) -> Column:
    """Whole quoted fields replaced by a letter."""
    return F.regexp_replace(text, rf'(?s)(?<=^|[{sep}])"[^"]*+(?:""[^"]*+)*+"(?=[{sep}\r]|$)', F.lit("q"))


def _opens(text: Column, sep: str) -> Column:
    """Whether a text entered outside quotes ends inside."""
    return F.coalesce(_without_quoted(text, sep).rlike(rf'(?s)(?:^|[{sep}])"[^"]*+(?:""[^"]*+)*+\z'), F.lit(False))


def lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``path, start, id, line, blank, from_out, from_in``: lines without their LF, in
    the order of ``id`` within a block, with the state each ends in, true for inside."""
    sep = _separator(delimiter)
    text = spark.read.option("lineSep", "\n").text(path)
    block = F.col("_metadata.file_block_start")
    first = F.when(block == 0, F.regexp_replace("value", r"\A\x{FEFF}", "")).otherwise(F.col("value"))
    rows = text.select(
        F.col("_metadata.file_path").alias("path"), block.alias("start"), F.monotonically_increasing_id().alias("id"), first.alias("line"),
        F.is_valid_utf8("value").alias("valid"),
    )
    closed = F.regexp_extract("line", r'(?s)\A[^"]*+(?:""[^"]*+)*+"', 0)
    rest = F.expr("concat('q', substr(line, length(closed) + 1))")
    quoted = F.contains("line", F.lit('"'))
    return rows.withColumn("closed", closed).select(
        *_BLOCK,
        "id",
        "line",
        "valid",
        F.col("line").isin("", "\r").alias("blank"),
        F.when(quoted, _opens(F.col("line"), sep)).otherwise(False).alias("from_out"),
        F.when(quoted & (F.col("closed") != ""), _opens(rest, sep)).otherwise(True).alias("from_in"),
    )


def _running(found: DataFrame) -> DataFrame:
    """Add the state after each line of a block, for both states before the block
    (``after_out``, ``after_in``), and the same before each line.

    A line that ends alike from both states settles the state; between such lines only
    those that turn it count.
    """
    order = Window.partitionBy(*_BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    settles = F.col("from_out") == F.col("from_in")
    turns = F.when(~settles & F.col("from_out"), 1).otherwise(0)
    counted = found.withColumn("turned", F.sum(turns).over(order))
    settled = F.when(settles, F.struct(F.col("from_out").alias("state"), F.col("turned").alias("turned")))
    known = counted.withColumn("known", F.last(settled, ignorenulls=True).over(order))

    def after(entry: bool) -> Column:
        since = F.col("turned") - F.coalesce(F.col("known.turned"), F.lit(0))
        base = F.coalesce(F.col("known.state"), F.lit(entry))
        return F.when(since % 2 == 1, ~base).otherwise(base)

    states = known.withColumns({"after_out": after(False), "after_in": after(True)})
    before = Window.partitionBy(*_BLOCK).orderBy("id")
    return states.withColumns(
        {
            "before_out": F.lag("after_out", 1, False).over(before),
            "before_in": F.lag("after_in", 1, True).over(before),
        }
    ).drop("known", "turned")


def _ends(state: str) -> Column:
    """Whether a record ends with a line: it leaves the quotes closed, and is not a
    blank line between records."""
    return ~F.col(f"after_{state}") & ~(F.col("blank") & ~F.col(f"before_{state}"))


def _entries(found: DataFrame) -> DataFrame:
    """``path, start, entered_inside, ended``: the state before each block, and how many
    records of its file end before it. One row for each block is all that meets."""
    blocks = written(
        _running(found.drop("line", "valid"))
        .groupBy(*_BLOCK)
        .agg(
            F.max_by("after_out", "id").alias("from_out"),
            F.max_by("after_in", "id").alias("from_in"),
            F.count_if(_ends("out")).alias("ends_out"),
            F.count_if(_ends("in")).alias("ends_in"),
        ),
        "export-blocks",
    )
    # Blocks compose like lines do: a file is one block of them.
    along = blocks.select("path", F.lit(0).alias("start"), F.col("start").alias("id"), "from_out", "from_in", "ends_out", "ends_in", F.lit(False).alias("blank"))
    placed = _running(along).withColumn("ends", F.when(F.col("before_out"), F.col("ends_in")).otherwise(F.col("ends_out")))
    before = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "path",
        F.col("id").alias("start"),
        F.col("before_out").alias("entered_inside"),
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"),
    )


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``path, record_no, record, __problem`` of all records, headers (1) included.

    A blank line between records is a row too, numbered as the record after it, with
    the problem ``blank_line``. A quote that is never closed is a ``stray_quote`` of the
    record that it makes of the rest of its file.
    """
    found = lines(spark, path, delimiter)
    entries = _entries(found)
    entries = entries.select(F.col("path").alias("in_path"), F.col("start").alias("in_start"), "entered_inside", "ended")
    states = _running(found)
    joined = states.join(entries, (F.col("path") == F.col("in_path")) & (F.col("start") == F.col("in_start")))
    inside = F.col("entered_inside")
    before = F.when(inside, F.col("before_in")).otherwise(F.col("before_out"))
    after = F.when(inside, F.col("after_in")).otherwise(F.col("after_out"))
    ends = F.when(inside, _ends("in")).otherwise(_ends("out"))
    earlier = Window.partitionBy(*_BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("ended") + F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(earlier), F.lit(0)) + 1
    marked = joined.select(
        *_BLOCK, "id", "line", "valid", number.cast("bigint").alias("record_no"), before.alias("before"), after.alias("after"), "blank"
    )
    whole = marked.filter(~F.col("before") & ~F.col("after"))
    blank = F.when(F.col("blank"), "blank_line")
    single = whole.select("path", "record_no", F.col("line").alias("record"), "valid", blank.alias(PROBLEM))
    # A record is as long as it is; only its own lines meet.
    several = marked.filter(F.col("before") | F.col("after")).groupBy("path", "record_no").agg(
        F.array_sort(F.collect_list(F.struct("start", "id", "line"))).alias("parts"), F.min("after").alias("closed_never"), F.min("valid").alias("valid")
    )
    open_ = F.when(F.col("closed_never"), "stray_quote")
    joined_ = several.select("path", "record_no", F.array_join(F.col("parts.line"), "\n").alias("record"), "valid", open_.alias(PROBLEM))
    both = single.unionByName(joined_).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    sep = _separator(delimiter)
    stray = _without_quoted(F.col("record"), sep).rlike(rf'(?:^|[{sep}])"')
    problem = F.coalesce(
        F.when(~F.col("valid"), "not_utf8"), F.col(PROBLEM), F.when(F.contains("record", F.lit('"')) & stray, "stray_quote")
    )
    return both.select("path", "record_no", "record", problem.alias(PROBLEM))


def parsed(found: DataFrame, headers: list[str], delimiter: str, options: dict[str, str | bool]) -> DataFrame:
    """The records' fields, all text, with the raw text of those of another width than
    the header, and of files whose header is another one."""
    corrupt = str(options["columnNameOfCorruptRecord"])
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*headers, corrupt]])
    plain = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    row = F.from_csv("record", ", ".join(f"`{f.name}` string" for f in schema), plain)
    rows = found.withColumn("row", row).withColumn(IS_HEADER, (F.col("record_no") == 1) & (F.coalesce(F.col(PROBLEM), F.lit("")) != "blank_line"))
    same = F.lit(True)
    for name in headers:
        same = same & F.col("row").getField(name).eqNullSafe(F.lit(name))
    other = F.when(F.col(IS_HEADER) & ~same, "other_header")
    fields = [F.col("row").getField(name).alias(name) for name in headers]
    raw = F.when(~F.col(IS_HEADER) & (F.coalesce(F.col(PROBLEM), F.lit("")) != "blank_line"), F.col("row").getField(corrupt))
    return rows.select(F.col("path").alias(SOURCE_FILE), "record_no", *fields, raw.alias(corrupt), F.coalesce(PROBLEM, other).alias(PROBLEM), IS_HEADER)
