"""Text expressions: Unicode strip, blank test, display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode-aware text trimming removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# How a cell is shown in a report.
NOT_PRESENT = "Not present"
EMPTY_VALUE = "Empty value"
DISPLAY_LIMIT = 240


def strip(cell: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, as ``str.strip`` does.

    Spark's plain ``trim`` removes spaces only. Trimming against a character set
    indexes the whole text, so it is done only where an end is whitespace; an
    empty text counts as such and stays empty.
    """
    marks = F.lit(WHITESPACE)
    loose = F.contains(marks, F.left(cell, F.lit(1))) | F.contains(marks, F.right(cell, F.lit(1)))
    return F.when(loose, F.btrim(cell, marks)).otherwise(cell)


def stripped_or_blank(cell: Column) -> Column:
    """``strip`` with NULL taken as a blank cell."""
    return F.coalesce(strip(cell), F.lit(""))


def display_value(cell: Column) -> Column:
    """Struct ``(shown, truncated)``: the printable form of a cell."""
    too_long = F.length(cell) > DISPLAY_LIMIT
    shown = (
        F.when(cell.isNull(), F.lit(NOT_PRESENT))
        .when(cell == "", F.lit(EMPTY_VALUE))
        .when(too_long, F.left(cell, F.lit(DISPLAY_LIMIT)))
        .otherwise(cell)
    )
    return F.struct(shown.alias("shown"), F.coalesce(too_long, F.lit(False)).alias("truncated"))
