"""Rule checks on literal cases and against whole columns in pandas."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwarden.operators import validation as v


def _dataset(spark, header, rows):
    schema = ", ".join(["record_no bigint", *[f"`{name}` string" for name in header]])
    return spark.createDataFrame([(n, *row) for n, row in enumerate(rows, 2)], schema)


def _codes(result):
    return [(row.row, row.column, row.code) for row in result.findings.collect()]


RULES = {
    "version": 1,
    "columns": {
        "sku": {"required": True, "unique": True},
        "mail": {"type": "email"},
        "price": {"type": "number", "min": 0, "max": 100},
        "day": {"type": "date"},
        "state": {"required": True, "allowed": ["new", "used"]},
        "absent": {},
    },
}


def test_findings_order_and_totals(spark):
    rows = [
        ("s1", "a@b.io", "10", "2024-05-01", "new"),
        ("s1 ", "nobody", "-1", "2024-13-01", " old "),
        (" ", "", "1e3", "", ""),
        ("s2", "x@y.z", "100.00000000000000000001", "2024-05-03", "used"),
    ]
    result = v.validate(_dataset(spark, ("sku", "mail", "price", "day", "state"), rows), RULES)
    assert _codes(result) == [
        (None, "absent", "missing_column"),
        (3, "sku", "duplicate"), (3, "mail", "type"), (3, "price", "min"), (3, "day", "type"), (3, "state", "allowed"),
        (4, "sku", "required"), (4, "price", "max"), (4, "state", "required"),
        (5, "price", "max"),
    ]
    assert result.summary.first().asDict() == {
        "rows": 4, "issues": 10, "affected_rows": 3, "reported_findings": 10, "status": "fail",
    }
    by_code = {row.code: row for row in result.findings.collect() if row.row == 3}
    assert by_code["duplicate"].message == "Duplicate value; first seen at record 2."
    assert by_code["allowed"].value == " old "


@pytest.mark.parametrize("cap", [0, 3, 100])
def test_cap_keeps_totals(spark, cap):
    ds = _dataset(spark, ("n",), [("x",)] * 7)
    rules = {"version": 1, "columns": {"n": {"type": "integer", "unique": True}}}
    result = v.validate(ds, rules, max_findings=cap)
    summary = result.summary.first()
    assert (summary.issues, summary.affected_rows, summary.reported_findings) == (13, 7, min(cap, 13))
    everything = [(r, "n", c) for r in range(2, 9) for c in ("type", "duplicate") if r > 2 or c == "type"]
    assert _codes(result) == everything[:cap]


def test_empty_dataset_with_missing_column_fails(spark):
    result = v.validate(_dataset(spark, ("a",), []), {"version": 1, "columns": {"b": {"required": True}}})
    assert _codes(result) == [(None, "b", "missing_column")]
    summary = result.summary.first()
    assert (summary.rows, summary.issues, summary.affected_rows, summary.status) == (0, 1, 0, "fail")


def test_no_issue_passes_and_null_is_blank(spark):
    ds = _dataset(spark, ("a",), [(None,), ("x",)])
    optional = {"version": 1, "columns": {"a": {"unique": True, "type": "string"}}}
    assert v.validate(ds, optional).summary.first().status == "pass"
    needed = {"version": 1, "columns": {"a": {"required": True}}}
    assert _codes(v.validate(ds, needed)) == [(2, "a", "required")]


def test_large_repeats_take_the_spread_join(spark, monkeypatch):
    """With nothing small enough to broadcast, the result is the same."""
    rows = [("hot",)] * 60 + [(f"k{n % 20}",) for n in range(60)]
    ds = _dataset(spark, ("a",), rows)
    plain = {(r.row, r.message) for r in v.unique(ds, "a").collect()}
    monkeypatch.setattr(v, "BROADCAST_ROWS", -1)
    monkeypatch.setattr("tabwarden.functions.hotkeys.HOT_KEYS", 1)
    spread = {(r.row, r.message) for r in v.unique(ds, "a").collect()}
    assert plain == spread
    assert len(spread) == 59 + 40


def test_many_datasets_in_one_job(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")]
    ds = _dataset(spark, ("run_id", "n"), rows)
    rules = {"version": 1, "columns": {"n": {"unique": True, "allowed": ["x"]}, "gone": {}}}
    found = v.all_findings(ds, rules, by=["run_id"]).collect()
    assert sorted((f.run_id, f.row or 0, f.code) for f in found) == [
        ("a", 0, "missing_column"), ("a", 3, "duplicate"), ("b", 0, "missing_column"), ("b", 5, "allowed"),
    ]
    totals = {r.run_id: (r.rows, r.issues, r.affected_rows) for r in v.validation_summary(ds, rules, by=["run_id"]).collect()}
    assert totals == {"a": (2, 2, 1), "b": (2, 2, 1)}


# --- against whole columns in pandas -------------------------------------------

SHAPES = {
    "string": lambda cells: pd.Series(True, cells.index),
    "integer": lambda cells: cells.str.fullmatch(r"[+-]?\d+"),
    "number": lambda cells: pd.to_numeric(cells, errors="coerce").notna(),
    "date": lambda cells: pd.to_datetime(cells, format="%Y-%m-%d", errors="coerce").notna(),
    "email": lambda cells: cells.str.count("@").eq(1) & cells.str.contains(r"\S@\S+\.\S"),
}


def _marks(cells, rule):
    """For each code the cells of one column that it marks."""
    filled = cells.ne("")
    fits = filled & SHAPES[rule.get("type", "string")](cells)
    amounts = pd.to_numeric(cells.where(fits), errors="coerce")
    return {
        "required": ~filled & rule.get("required", False),
        "type": filled & ~fits,
        "min": amounts.lt(rule.get("min", -np.inf)),
        "max": amounts.gt(rule.get("max", np.inf)),
        "allowed": filled & ~cells.isin(rule.get("allowed", cells)),
        "duplicate": filled & cells.duplicated() & rule.get("unique", False),
    }


def _by_column(header, rows, rules):
    """Findings, one check after the other over whole columns, sorted at the end."""
    table = pd.DataFrame(rows, columns=header, index=range(2, len(rows) + 2)).apply(lambda cells: cells.str.strip())
    names = list(rules["columns"])
    found = [(0, names.index(name), 0) for name in set(names) - set(header)]
    for name in set(names) & set(header):
        marks = pd.DataFrame(_marks(table[name], rules["columns"][name])).stack()
        found += [(row, names.index(name), v.CODES.index(code)) for row, code in marks[marks].index]
    return [(row or None, names[column], v.CODES[code]) for row, column, code in sorted(found)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_datasets_agree_with_whole_columns(spark, seed):
    rng = random.Random(seed)
    pool = ["", " ", "a", "a ", "\ta", "b", "1", "1.0", "-3", "1e2", "x@y.z", "2024-02-30", "2024-02-03", " 7", "0.5"]
    header = ["p", "q", "r"]
    rows = [tuple(rng.choices(pool, k=3)) for _ in range(rng.randint(20, 80))]
    rules = {
        "version": 1,
        "columns": {
            "r": {"type": rng.choice(["number", "integer"]), "min": -1, "max": 5, "unique": True},
            "gone": {"required": True},
            "p": {"required": True, "allowed": ["a", "b", "1"]},
            "q": {"type": rng.choice(["date", "email"]), "unique": True},
        },
    }
    result = v.validate(_dataset(spark, header, rows), rules, max_findings=5000)
    expected = _by_column(header, rows, rules)
    assert _codes(result) == expected
    summary = result.summary.first()
    assert summary.issues == len(expected)
    assert summary.affected_rows == len({row for row, _, _ in expected if row})


def test_single_checks_read_only_their_column(spark):
    ds = _dataset(spark, ("a", "b"), [("5", "x")])
    assert v.max_bound(ds, "a", 4).count() == 1
    assert v.min_bound(ds, "a", Decimal("5.1")).count() == 1
    assert v.allowed(ds, "b", ["x"]).count() == 0
    assert v.type_check(ds, "b", "integer").count() == 1
    assert v.cap_notice(ds.select(F.lit(1500).alias("issues"), F.lit(500).alias("reported_findings"))).first().notice == "Showing 500 of 1,500 findings."
