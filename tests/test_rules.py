from __future__ import annotations

import json
from decimal import Decimal

import pytest

from tabwarden.operators.rules import RuleError, check_rules
from tabwarden.sources.rule_docs import rule_catalog


def _document(**rule):
    return {"version": 1, "columns": {"c": rule}}


def test_bounds_stay_exact_and_order_is_kept():
    text = '{"version":1,"columns":{"z":{"type":"number","max":0.30000000000000000001},"a":{}}}'
    rules = check_rules(text)
    assert [rule.column for rule in rules] == ["z", "a"]
    assert rules[0].max == Decimal("0.30000000000000000001")


BAD = [
    "[]",
    "{",
    '{"version":1}',
    '{"version":1,"columns":{},"more":1}',
    '{"version":true,"columns":{}}',
    '{"version":1.0,"columns":{}}',
    '{"version":2,"columns":{}}',
    '{"version":1,"columns":[]}',
    '{"version":1,"columns":{" ":{}}}',
    '{"version":1,"columns":{"a":{},"a":{}}}',
    '{"version":1,"columns":{"a":{"min":Infinity,"type":"number"}}}',
] + [
    json.dumps(_document(**rule))
    for rule in (
        {"pattern": "x"}, {"required": 1}, {"unique": "no"}, {"type": "float"}, {"type": None},
        {"min": 1}, {"type": "date", "max": 1}, {"type": "number", "min": "1"},
        {"type": "number", "max": False}, {"type": "integer", "min": 3, "max": 2},
        {"allowed": []}, {"allowed": "ab"}, {"allowed": ["a", 1]},
    )
]


@pytest.mark.parametrize("text", BAD)
def test_bad_documents_are_refused(text):
    with pytest.raises(RuleError):
        check_rules(text)


def test_catalog_agrees_with_driver_side_checks(spark):
    good = ['{"version":1,"columns":{"b":{"required":true},"a":{"type":"integer","min":1,"max":2}}}', "﻿" + json.dumps(_document(allowed=["x"]))]
    docs = spark.createDataFrame(list(enumerate([*BAD, *good])), "rule_set bigint, doc string")
    rules, lint = rule_catalog(docs)
    # A version written 1.0 is a number in JSON; only the driver side tells it from 1.
    linted = {row.rule_set for row in lint.collect()}
    assert linted >= set(range(len(BAD))) - {BAD.index('{"version":1.0,"columns":{}}')}
    found = sorted((row.rule_set, row.col_idx, row.column) for row in rules.collect())
    first = len(BAD)
    assert found == [(first, 0, "b"), (first, 1, "a"), (first + 1, 0, "c")]
