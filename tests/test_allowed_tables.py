"""Allowed values as a table: each way of looking them up, against a plain loop."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tabwarden.functions import hotkeys
from tabwarden.operators import validation as v


@pytest.fixture(params=["list broadcast", "unlisted broadcast", "spread join"])
def way(request, monkeypatch):
    """Which of the two sizes are taken as small."""
    answers = {"list broadcast": [True], "unlisted broadcast": [False, True], "spread join": [False, False]}[request.param]
    asked = iter(answers)
    monkeypatch.setattr(v, "_fits_broadcast", lambda frame: next(asked))
    monkeypatch.setattr(hotkeys, "SPLIT_ROWS", 10)
    yield request.param
    assert next(asked, None) is None


def test_every_way_finds_the_same(spark, way):
    cells = ["a", " a ", "b", "", None, "  ", "B", "é", "c"] + ["hot"] * 60 + ["a"] * 60
    allowed = ["a", " b", "", None, "b", "é\t", "never"]
    ds = spark.createDataFrame(list(enumerate(cells, 2)), "record_no bigint, x string")
    found = v.allowed_in(ds, "x", spark.createDataFrame([(a,) for a in allowed], "name string"))
    listed = {a.strip() for a in allowed if a and a.strip()}
    expected = [(n, c) for n, c in enumerate(cells, 2) if c and c.strip() and c.strip() not in listed]
    assert sorted((r.row, r.value) for r in found.collect()) == expected
    assert {(r.column, r.code, r.message) for r in found.collect()} == {("x", "allowed", v.MESSAGES["allowed"])}


def test_an_empty_list_allows_nothing(spark, way):
    ds = spark.createDataFrame([(2, "a"), (3, ""), (4, None)], "record_no bigint, x string")
    assert [r.row for r in v.allowed_in(ds, "x", spark.createDataFrame([], "name string")).collect()] == [2]


def test_a_million_values_leave_no_list_in_the_plan(spark):
    ds = spark.range(1_000, 1_002_000, 500).select(F.col("id").alias("record_no"), F.col("id").cast("string").alias("x"))
    found = v.allowed_in(ds, "x", spark.range(1_000_000).select(F.col("id").cast("string")))
    text = io.StringIO()
    with redirect_stdout(text):
        found.explain()
    assert " IN (" not in text.getvalue() and "INSET" not in text.getvalue()
    assert len(text.getvalue()) < 20_000
    assert sorted(r.row for r in found.collect()) == [1_000_000, 1_000_500, 1_001_000, 1_001_500]
