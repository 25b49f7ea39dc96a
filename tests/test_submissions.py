from __future__ import annotations

import json

import pytest

from tabwarden.operators import submissions as s

FILES = [("box/d/a.csv", 10, "A"), ("box/d/b.csv", 10, "B"), ("box/d/a2.csv", 10, "A"), ("box/d/big.csv", 11 * 1024 * 1024, "C")]
GOOD = {"event_type": "orders_check", "input": "d/a.csv", "rules": "d/b.csv", "before": "d/b.csv", "after": "d/b.csv"}


def _receipts(spark, documents):
    rows = []
    for n, document in enumerate(documents):
        text = document if isinstance(document, str) else json.dumps(document)
        rows.append((n, "scan", "box/job.json", f"hash{text}", text))
    return spark.createDataFrame(rows, "receipt_seq bigint, scan_id string, path string, raw_hash string, doc string")


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, length bigint, sha256 string")


def _without(name):
    return {k: v for k, v in GOOD.items() if k != name}


CASES = [
    (GOOD, None),
    ("﻿" + json.dumps(GOOD), None),
    ({**GOOD, "input": "d\\a.csv", "key": " k "}, None),
    ({**GOOD, "input": "d/../../box/d/./a.csv"}, None),
    ("{", "invalid_json"),
    ("[]", "not_an_object"),
    (json.dumps(GOOD) + "{}", "invalid_json"),
    ('{"key":"a","key":"b"}', "invalid_json"),
    ('{"key":-Infinity}', "invalid_json"),
    (" " * (64 * 1024 + 1), "too_large"),
    (_without("before"), "missing:before"),
    ({"zz": 1}, "missing:after"),
    ({**GOOD, "mod": "os", "lib": "x"}, "unknown:lib"),
    ({**GOOD, "rules": 5, "input": None}, "not_text:input"),
    ({**GOOD, "key": []}, "not_text:key"),
    ({**GOOD, "event_id": "a\0b"}, "not_text:event_id"),
    ({**GOOD, "event_type": "other"}, "event_type"),
    ({**GOOD, "key": "a\nb"}, "key"),
    ({**GOOD, "key": "k" * 257}, "key"),
    ({**GOOD, "event_id": "e" * 257}, "event_id"),
    ({**GOOD, "input": "/d/a.csv"}, "absolute:input"),
    ({**GOOD, "rules": "C:\\d\\b.csv"}, "absolute:rules"),
    ({**GOOD, "after": "\\\\host\\share"}, "absolute:after"),
    ({**GOOD, "before": "../d/b.csv"}, "escapes:before"),
    ({**GOOD, "before": "../boxer/b.csv"}, "escapes:before"),
    ({**GOOD, "input": "d"}, "absent:input"),
    ({**GOOD, "input": "none", "rules": "/x"}, "absent:input"),
    ({**GOOD, "after": "d/big.csv"}, "too_large:after"),
]


def test_first_problem_of_each_document(spark, files):
    found = s.validated(_receipts(spark, [document for document, _ in CASES]), files)
    assert [r.error for r in found.orderBy("receipt_seq").collect()] == [error for _, error in CASES]


def test_identity_is_content_and_settings(spark, files):
    documents = [GOOD, dict(reversed(GOOD.items())), {**GOOD, "input": "d/a2.csv", "event_id": "x"}, {**GOOD, "key": "alt"}, {**GOOD, "input": "d/b.csv"}]
    rows = s.validated(_receipts(spark, documents), files).orderBy("receipt_seq").collect()
    same, other = {r.fingerprint for r in rows[:3]}, {r.fingerprint for r in rows[3:]}
    assert len(same) == 1 and len(other) == 2 and not same & other
    assert rows[0].execution_fingerprint == rows[1].execution_fingerprint != rows[2].execution_fingerprint


def test_duplicates_aliases_conflicts_and_invalid(spark, files):
    documents = [
        {**GOOD, "event_id": "one"}, GOOD, {**GOOD, "event_id": "two"}, {**GOOD, "event_id": "one"},
        {**GOOD, "event_id": "two", "key": "alt"}, {**GOOD, "key": "alt"}, {**GOOD, "event_id": "two", "key": "alt"},
        "{", "{", {**GOOD, "event_id": "bad", "input": "none"}, {**GOOD, "event_id": "bad", "key": "alt"},
    ]
    resolved = s.resolved_receipts(_receipts(spark, documents), files)
    events = {r.first_seq: r.duplicates for r in s.canonical_events(resolved).collect()}
    assert events == {0: 3, 5: 1}
    conflicts = resolved.filter("error = 'external_id_conflict'").orderBy("receipt_seq").collect()
    assert [r.receipt_seq for r in conflicts] == [4, 6]
    assert sorted(r.external_id for r in s.external_aliases(resolved).collect()) == ["bad", "one", "two"]
    invalid = sorted((r.first_seq, r.error, r.repeats) for r in s.invalid_events(resolved).collect())
    assert invalid == [(4, "external_id_conflict", 1), (7, "invalid_json", 1), (9, "absent:input", 0)]


def test_event_states(spark):
    events = spark.createDataFrame(
        [("a", "r1", "CLAIMED", None), ("b", "r2", "FAILED", "old"), ("c", "r3", "CLAIMED", None), ("d", "r4", "CLAIMED", None), ("e", None, "INVALID", "bad")],
        "id string, workflow_run_id string, status string, error string",
    )
    runs = spark.createDataFrame([("r1", "SUCCEEDED", None), ("r2", "RUNNING", None), ("r3", "FAILED", "why"), ("r4", "FAILED", "limit")], "run_id string, status string, failure_reason string")
    limits = spark.createDataFrame([("r4", "revision_limit_reached"), ("r1", "run_completed")], "run_id string, event string")
    states = s.event_status(events, runs, limits)
    assert {r.id: (r.status, r.error, r.retryable) for r in states.collect()} == {
        "a": ("COMPLETED", None, False), "b": ("FAILED", "old", True), "c": ("FAILED", "why", True),
        "d": ("FAILED", "limit", False), "e": ("INVALID", "bad", False),
    }
    assert sorted(r.id for r in s.retry_eligible(states).collect()) == ["b", "c"]


def test_receipts_of_one_split_are_read_by_many_tasks_and_once(spark, tmp_path):
    """Reading documents is spread and written; presence takes them from there."""
    doc = '{"event_type":"orders_check","input":"./a//x.csv","rules":"b/../c.csv","before":"d.csv","after":"../e.csv"}'
    receipts = spark.range(40000).coalesce(1).selectExpr(
        "id AS receipt_seq", "'s' AS scan_id", "'in/box/job.json' AS path", "concat(sha2(string(id), 512), sha2(string(-id), 512)) AS raw_hash", f"'{doc}' AS doc"
    )
    checked = s.checked_receipts(receipts)
    assert len(checked.inputFiles()) > 1 and checked.count() == 40000
    roles = s.path_containment(checked)
    assert "parse_json" not in roles._jdf.queryExecution().toString()
    found = {(r.role, r.source_path, r.error) for r in roles.collect()}
    assert found == {("input", "in/box/a/x.csv", None), ("rules", "in/box/c.csv", None), ("before", "in/box/d.csv", None), ("after", None, "escapes:after")}
