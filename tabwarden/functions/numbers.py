"""Exact comparison of decimal text with a bound, without rounding.

Most values fit ``DECIMAL(18,6)``, which Spark keeps and compares as a long. The
rest (more digits, or an exponent) are compared by sign, then by the position of the first
significant digit, then by the significant digits as text. Both ways stay
inside Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which text counts as a whole number or a number.
INTEGER_PATTERN = r"^[+-]?[0-9]+\z"
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

# The exponent range of an arbitrary-precision decimal.
MAX_LEADING_EXPONENT = 999_999_999_999_999_999
MIN_LAST_EXPONENT = -1_999_999_999_999_999_997

_PLAIN = r"^[+-]?([0-9]{1,12}(\.[0-9]{0,6})?|\.[0-9]{1,6})\z"
_QUICK_TYPE = "decimal(18,6)"
_QUICK_LIMIT = Decimal(10) ** 12
_QUICK_STEP = Decimal("0.000001")
_PARTS = r"^[+-]?([0-9]*)\.?([0-9]*)[eE]?([+-]?[0-9]*)\z"
_EXPONENT_RANGE = 3_000_000_000_000_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Only the rare values that need the long way pay for the one-element array;
    generated code stays small however many numeric rules there are.
    """
    return F.transform(F.array(value), body)[0]


def _shape(value: Column) -> Column:
    """Struct of sign, position of the first significant digit, significant
    digits, and position of the last written digit (NULL if out of range)."""
    exponent_text = F.regexp_extract(value, _PARTS, 3)
    exponent = F.when(exponent_text == "", F.lit("0")).otherwise(exponent_text).try_cast("bigint")
    parts = F.struct(
        F.regexp_extract(value, _PARTS, 1).alias("whole"),
        F.regexp_extract(value, _PARTS, 2).alias("fraction"),
        exponent.alias("exponent"),
        value.startswith("-").alias("negative"),
    )

    def significant(p: Column) -> Column:
        in_range = p.exponent.between(-_EXPONENT_RANGE, _EXPONENT_RANGE)
        return F.struct(
            F.ltrim(F.concat(p.whole, p.fraction), F.lit("0")).alias("unpadded"),
            F.when(in_range, p.exponent - F.length(p.fraction)).alias("last"),
            p.negative.alias("negative"),
        )

    def shape(p: Column) -> Column:
        digits = F.rtrim(p.unpadded, F.lit("0"))
        sign = F.when(p.unpadded == "", 0).when(p.negative, -1).otherwise(1)
        return F.struct(
            sign.alias("sign"),
            (p.last + F.length(p.unpadded)).alias("lead"),
            digits.alias("digits"),
            p.last.alias("last"),
        )

    return _let(_let(parts, significant), shape)


def is_integer(value: Column) -> Column:
    return value.rlike(INTEGER_PATTERN)


def _exponent_fits(value: Column) -> Column:
    def fits(shape: Column) -> Column:
        first = F.when(shape.sign == 0, shape.last).otherwise(shape.lead - 1)
        return F.coalesce(
            (first <= MAX_LEADING_EXPONENT) & (shape.last >= MIN_LAST_EXPONENT), F.lit(False)
        )

    return _let(_shape(value), fits)


def quick_decimal(value: Column) -> Column:
    """The number as a short decimal where that holds it exactly, else NULL."""
    return F.when(value.rlike(_PLAIN), value.try_cast(_QUICK_TYPE))


def is_number(value: Column, quick: Column | None = None) -> Column:
    """Finite decimal text whose exponent an exact decimal can hold.

    ``quick`` is :func:`quick_decimal` of the value, where already computed.
    """
    quick = quick_decimal(value) if quick is None else quick
    rare = value.rlike(NUMBER_PATTERN) & F.when(~value.rlike("[eE]"), F.lit(True)).otherwise(
        _exponent_fits(value)
    )
    return F.when(quick.isNotNull(), F.lit(True)).otherwise(rare)


def _bound_shape(bound: Decimal) -> tuple[int, int, str]:
    sign, digits, exponent = bound.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    lead = int(exponent) + len(text)
    significant = text.rstrip("0")
    if not significant:
        return 0, 0, ""
    return (-1 if sign else 1), lead, significant


def _quick_side(quick: Column, bound: Decimal) -> Column:
    """Side of a short decimal. A bound between two short decimals is replaced by
    the one below it, which no value above the bound can equal."""
    if bound >= _QUICK_LIMIT:
        return F.when(quick.isNotNull(), -1)
    if bound <= -_QUICK_LIMIT:
        return F.when(quick.isNotNull(), 1)
    with localcontext() as exact:
        exact.prec = max(50, len(bound.as_tuple().digits) + 20)
        below = bound.quantize(_QUICK_STEP, rounding=ROUND_FLOOR)
    limit = F.lit(format(below, "f")).cast(_QUICK_TYPE)
    on_grid = 0 if below == bound else -1
    return F.when(quick < limit, -1).when(quick > limit, 1).when(quick.isNotNull(), on_grid)


def compare_numbers(value: Column, other: Column) -> Column:
    """-1, 0 or 1 as one number text lies below, on or above another, whatever the
    number of digits. Both must be valid numbers."""

    def against(pair: Column) -> Column:
        x, y = pair.x, pair.y
        magnitude = (
            F.when(x.lead < y.lead, -1)
            .when(x.lead > y.lead, 1)
            .when(x.digits < y.digits, -1)
            .when(x.digits > y.digits, 1)
            .otherwise(0)
        )
        return (
            F.when(x.sign < y.sign, -1)
            .when(x.sign > y.sign, 1)
            .when(x.sign == 0, 0)
            .otherwise(magnitude * x.sign)
        )

    return _let(F.struct(_shape(value).alias("x"), _shape(other).alias("y")), against)


def compare_to_bound(value: Column, bound: Decimal, quick: Column | None = None) -> Column:
    """-1, 0 or 1 as the number text ``value`` lies below, on or above ``bound``.

    ``value`` must already be a valid number.
    """
    quick = quick_decimal(value) if quick is None else quick
    sign_b, lead_b, digits_b = _bound_shape(bound)

    def against(shape: Column) -> Column:
        magnitude = (
            F.when(shape.lead < lead_b, -1)
            .when(shape.lead > lead_b, 1)
            .when(shape.digits < digits_b, -1)
            .when(shape.digits > digits_b, 1)
            .otherwise(0)
        )
        return (
            F.when(shape.sign < sign_b, -1)
            .when(shape.sign > sign_b, 1)
            .when(shape.sign == 0, 0)
            .otherwise(magnitude * shape.sign)
        )

    exact = _let(_shape(value), against)
    return F.coalesce(_quick_side(quick, bound), exact)
