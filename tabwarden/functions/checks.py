"""Predicates for the semantic column types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabwarden.functions.numbers import is_integer, is_number

# The text forms of an address and a calendar day.
EMAIL_PATTERN = r"(?U)^[^@\s\x1c-\x1f]+@[^@\s\x1c-\x1f]+\.[^@\s\x1c-\x1f]+\z"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"

# The semantic types a rule may name.
COLUMN_TYPES = ("date", "email", "integer", "number", "string")


def is_email(value: Column) -> Column:
    return value.rlike(EMAIL_PATTERN)


def is_date(value: Column) -> Column:
    """A real calendar day from year 1 on, in exactly ten characters."""
    return (
        value.rlike(DATE_PATTERN)
        & value.try_cast("date").isNotNull()
        & ~value.startswith("0000")
    )


def is_valid(value: Column, column_type: str, quick: Column | None = None) -> Column:
    """Whether stripped nonblank text has the given semantic type; ``quick`` is
    the value as a decimal, where already computed."""
    if column_type == "integer":
        return is_integer(value)
    if column_type == "number":
        return is_number(value, quick)
    if column_type == "email":
        return is_email(value)
    if column_type == "date":
        return is_date(value)
    return F.lit(True)
