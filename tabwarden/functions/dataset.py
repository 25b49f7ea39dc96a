"""What a dataset frame holds besides its fields."""

from __future__ import annotations

from pyspark.sql import DataFrame

RECORD_NO = "record_no"
SOURCE_FILE = "_source_file"

#: Columns about a record, never part of it.
META_COLUMNS = (RECORD_NO, SOURCE_FILE)


def header(df: DataFrame) -> list[str]:
    """The names of the fields, in order."""
    return [name for name in df.columns if name not in META_COLUMNS]
