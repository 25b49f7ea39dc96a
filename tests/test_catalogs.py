"""Header, rule and key catalogs of many datasets, NULL datasets included."""

from __future__ import annotations

from tabwarden.operators import catalogs as k
from tabwarden.operators.comparison import schema_diff_catalog

COLUMNS = "dataset string, `column` string"


def test_missing_columns_and_coverage(spark):
    rules = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), (None, "x"), (None, "z")], COLUMNS)
    headers = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), (None, "x")], COLUMNS)
    found = k.missing_columns(rules, headers).collect()
    assert sorted((str(r.dataset), r.column, r.row, r.code) for r in found) == [
        ("None", "z", None, "missing_column"), ("a", "y", None, "missing_column"),
    ]
    cover = {r.dataset: (r.configured, r.missing, r.complete) for r in k.header_coverage(rules, headers).collect()}
    assert cover == {"a": (2, 1, False), "b": (1, 0, True), None: (2, 1, False)}


def test_no_rules_and_no_headers(spark):
    rules = spark.createDataFrame([("a", "x")], COLUMNS)
    none = rules.limit(0)
    assert k.missing_columns(rules, none).count() == 1
    assert k.missing_columns(none, rules).count() == 0
    assert k.header_coverage(none, rules).count() == 0


def test_key_contracts(spark):
    keys = spark.createDataFrame([("a", "x"), ("b", " "), ("c", None), ("d", "x"), (None, "x")], "dataset string, key string")
    before = spark.createDataFrame([("a", "x"), ("d", "y"), (None, "x")], COLUMNS)
    after = spark.createDataFrame([("a", "x"), ("d", "x")], COLUMNS)
    found = {(r.dataset, r.side, r.problem) for r in k.key_contracts(keys, before, after).collect()}
    assert found == {
        ("b", "", "blank_key"), ("c", "", "blank_key"), ("d", "before", "missing_key"), (None, "after", "missing_key"),
    }


def test_every_catalog_row_counts_in_the_schema_change(spark):
    before = spark.createDataFrame([("a", "x"), ("b", "x")], COLUMNS)
    after = spark.createDataFrame([("a", "x"), ("a", "y")], COLUMNS)
    found = {(r.dataset, r.column, r.change) for r in schema_diff_catalog(before, after).collect()}
    assert found == {("a", "y", "added"), ("b", "x", "removed")}
