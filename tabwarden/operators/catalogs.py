"""Checks of headers, rules and keys of many datasets in one job.

A header catalog has one row per ``(dataset, column)``, a rule catalog one per
``(dataset, column)`` with a ``place``, a key catalog one per ``dataset`` with the
``key`` its snapshots are compared by. Repeated rows count once, and a NULL dataset
is a dataset of its own. Joins are on dataset and column, so that a dataset of very
many columns is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.text import stripped_or_blank
from tabwarden.operators.validation import FINDING_COLUMNS, MESSAGES


def _pair(left: DataFrame, right: DataFrame, *names: str) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & left[name].eqNullSafe(right[name])
    return same


def missing_columns(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """A finding for each configured column that the header of its dataset lacks."""
    configured = rules.select("dataset", "column").distinct()
    known = headers.select("dataset", "column").distinct()
    absent = configured.join(known, _pair(configured, known, "dataset", "column"), "left_anti")
    found = absent.select(
        "dataset",
        F.lit(None).cast("bigint").alias("row"),
        "column",
        F.lit("missing_column").alias("code"),
        F.lit(MESSAGES["missing_column"]).alias("message"),
        F.lit("").alias("value"),
    )
    return found.select("dataset", *FINDING_COLUMNS)


def header_coverage(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """Relational division: which datasets have every column their rules name.

    One row per dataset with rules: how many columns are configured, how many of
    them are missing, and whether the header is complete.
    """
    configured = rules.select("dataset", "column").distinct()
    known = headers.select("dataset", "column", F.lit(True).alias("present")).distinct()
    both = configured.join(known, _pair(configured, known, "dataset", "column"), "left")
    return both.groupBy(configured["dataset"]).agg(
        F.count(F.lit(1)).alias("configured"),
        F.count_if(F.col("present").isNull()).alias("missing"),
        (F.count_if(F.col("present").isNull()) == 0).alias("complete"),
    )


def key_contracts(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What is wrong with the keys of many comparisons: ``(dataset, key, side, problem)``.

    A blank key is one problem of no side, as no header can have it; any other key
    must be in the headers of both sides.
    """
    named = keys.select("dataset", "key").distinct()
    blank = stripped_or_blank(F.col("key")) == ""
    problems = named.filter(blank).select(
        "dataset", "key", F.lit("").alias("side"), F.lit("blank_key").alias("problem")
    )
    asked = named.filter(~blank)
    for side, headers in (("before", before), ("after", after)):
        known = headers.select("dataset", F.col("column").alias("key")).distinct()
        lacking = asked.join(known, _pair(asked, known, "dataset", "key"), "left_anti")
        problems = problems.unionByName(
            lacking.select("dataset", "key", F.lit(side).alias("side"), F.lit("missing_key").alias("problem"))
        )
    return problems
