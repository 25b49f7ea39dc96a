"""Scalar rules: whitespace, numbers, dates, addresses, display."""

from __future__ import annotations

import random
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import functions as F

from tabwarden.functions.checks import is_date, is_email
from tabwarden.functions.numbers import compare_to_bound, is_integer, is_number
from tabwarden.functions.text import WHITESPACE, display_value, strip


def _column(spark, values):
    return spark.createDataFrame([(value,) for value in values], "v string")


def test_strip_removes_what_text_strip_removes(spark):
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    values = [f"{mark}a b{mark}" for mark in WHITESPACE] + ["", "   ", "​x​", "﻿y"]
    rows = _column(spark, values).select("v", strip(F.col("v")).alias("s")).collect()
    assert [row.s for row in rows] == [row.v.strip() for row in rows]


NUMBER_TEXT = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def _decimal(text):
    if not NUMBER_TEXT.fullmatch(text):
        return None
    try:
        return Decimal(text)
    except InvalidOperation:
        return None


def _random_number(rng):
    text = rng.choice(["", "-", "+"]) + "".join(rng.choices("00123459", k=rng.randint(1, 24)))
    if rng.random() < 0.6:
        text += "." + "".join(rng.choices("00123459", k=rng.randint(0, 24)))
    if rng.random() < 0.4:
        text += rng.choice("eE") + rng.choice(["", "-", "+"]) + str(rng.randint(0, 30))
    return text


def test_numbers_agree_with_exact_decimals(spark):
    rng = random.Random(7)
    values = [
        "7", "+7", ".5", "5.", "-0", "1e3", "1_000", "1,200", "NaN", "Infinity", "e5", ".", "٣",
        "1e999999999999999999", "1e1000000000000000000", "10e999999999999999999",
        "0e1000000000000000000", "1.5e-1999999999999999997", "1.5e-1999999999999999996",
        "0012e999999999999999999", "1e99999999999999999999999", "0.30000000000000000001", "1e-30",
    ] + [_random_number(rng) for _ in range(400)]
    bounds = [Decimal(b) for b in ("0", "0.3", "-1.5", "1e40", "1e-30", "123456789012345678901")]
    valid = is_number(F.col("v"))
    sides = [
        F.when(valid, compare_to_bound(F.col("v"), bound)).alias(f"b{place}")
        for place, bound in enumerate(bounds)
    ]
    for row in _column(spark, values).select("v", valid.alias("valid"), *sides).collect():
        number = _decimal(row.v)
        assert row.valid == (number is not None), row.v
        for place, bound in enumerate(bounds):
            expected = None if number is None else (number > bound) - (number < bound)
            assert row[f"b{place}"] == expected, (row.v, bound)


def test_text_forms(spark):
    cases = {
        is_integer: {"12": True, "+3": True, "-0": True, "1.0": False, "1\n": False, "": False, "٣": False},
        is_date: {
            "2024-02-29": True, "2023-02-29": False, "0000-01-01": False, "0001-01-01": True,
            "2024-2-29": False, "2024-01-01T00:00": False, "２024-01-01": False,
        },
        is_email: {
            "a@b.c": True, "a@b": False, "a b@c.d": False, "a@@b.c": False, "a@b.c d": False,
            "@b.c": False, "a@b.c.d": True,
        },
    }
    for check, table in cases.items():
        rows = _column(spark, list(table)).select("v", check(F.col("v")).alias("ok")).collect()
        assert {row.v: row.ok for row in rows} == table


def test_display_value(spark):
    rows = _column(spark, [None, "", "x" * 240, "y" * 241]).select(display_value(F.col("v")).alias("d")).collect()
    assert [tuple(row.d) for row in rows] == [
        ("Not present", False), ("Empty value", False), ("x" * 240, False), ("y" * 240, True),
    ]
