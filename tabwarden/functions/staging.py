"""Keeping costly expressions from being computed more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select columns behind a generator of one row.

    Filters on a computed column are normally pushed below the projection that
    computes it, with a second copy of its expression; they cannot pass a
    generator. Use this where the expression parses or folds.
    """
    row = F.explode(F.array(F.struct(*columns))).alias("row")
    return df.select(row).select("row.*")
