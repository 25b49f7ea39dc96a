"""Nested evidence against a plain recursive bound."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tabwarden.operators import evidence as e


def _plain(value, depth=0):
    if isinstance(value, str):
        return (value[:500] + e.CUT_MARK, True) if len(value) > 500 else (value, False)
    if not isinstance(value, (dict, list)):
        return value, False
    if depth >= 5:
        return (e.DEEP_OBJECT if isinstance(value, dict) else e.DEEP_LIST), True
    cut = len(value) > 20
    if isinstance(value, list):
        parts = [_plain(item, depth + 1) for item in value[:20]]
        return [shown for shown, _ in parts], cut or any(trimmed for _, trimmed in parts)
    parts = {name: _plain(value[name], depth + 1) for name in sorted(value)[:20]}
    return {name: shown for name, (shown, _) in parts.items()}, cut or any(trimmed for _, trimmed in parts.values())


def _random(rng, depth=0):
    kind = rng.choice("tnbxoolloll" if depth < 8 else "tnbx")
    if kind == "t":
        return rng.choice(['a "quoted" \\ text', "", "é\n\t\u0001😀", "w" * 500, "w" * 501])
    if kind == "n":
        return rng.choice([0, -7, 12345678901, 2.5])
    if kind == "b":
        return rng.choice([True, False])
    if kind == "x":
        return None
    size = rng.choice([0, 1, 1, 2, 2, 21, 25]) if depth < 2 else rng.choice([0, 1, 2])
    items = [_random(rng, depth + 1) for _ in range(size)]
    return items if kind == "l" else {rng.choice(["n", 'q"', "é.", "$"]) + f"{n:02d}": item for n, item in enumerate(items)}


def test_random_values_against_a_recursive_bound(spark):
    rng = random.Random(3)
    values = [_random(rng) for _ in range(300)]
    deep = "leaf"
    for n in range(9):
        deep = {"in": deep} if n % 2 else [deep]
        values += [deep, {"a": deep}]
    rows = spark.createDataFrame([(n, json.dumps(value)) for n, value in enumerate(values)], "n int, doc string")
    found = rows.select("n", e.bounded_json(F.parse_json("doc")).alias("b")).select("n", "b.*").collect()
    assert len(found) == len(values)
    got = {row.n: (json.loads(row.shown), row.trimmed) for row in found}
    assert got == {n: _plain(value) for n, value in enumerate(values)}


def test_missing_value(spark):
    rows = spark.createDataFrame([(None,), ("null",)], "doc string")
    found = rows.select(e.bounded_json(F.parse_json("doc")).alias("b")).select("b.*").collect()
    assert [tuple(row) for row in found] == [("null", False), ("null", False)]
