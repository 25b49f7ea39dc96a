"""Run documents: every section, and what is absent, broken or repeated."""

from __future__ import annotations

import json

from tabwarden.operators.run_history import MAX_LISTED_APPROVALS, run_document

RUNS = "run_id string, status string, failure_reason string, config_json string"
TASKS = "run_id string, task_id string, status string, attempts bigint, error string, output_json string"
APPROVALS = (
    "run_id string, id string, iteration bigint, status string, decision string, comment string, "
    "decided_at string, briefing_json string"
)
EVENTS = "workflow_run_id string, id string, event_id string, event_type string, manifest_path string, fingerprint string, status string"
JOBS = (
    "workflow_run_id string, id string, status string, attempts bigint, budget_attempts bigint, max_attempts bigint, "
    "replay_count bigint, last_error string"
)


def _documents(spark, runs, tasks=(), approvals=(), events=(), jobs=()):
    pairs = ((runs, RUNS), (tasks, TASKS), (approvals, APPROVALS), (events, EVENTS), (jobs, JOBS))
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in pairs]
    rows = run_document(*frames).collect()
    assert len(rows) == len(runs)
    return {row.run_id: json.loads(row.document) for row in rows}


def test_a_full_run(spark):
    tasks = [
        ("r", "briefing_agent", "succeeded", 1, None, '{"v":0}'), ("r", "planner", "succeeded", 1, None, "{}"),
        ("r", "quality_agent", "succeeded", 2, None, '{"a":1}'), ("r", "change_agent", "failed", 2, 'bad "x"', '{"b":1}'),
        ("r", "own_step", "succeeded", 1, None, "{}"),
    ]
    approvals = [
        ("r", "a2", 2, "pending", None, None, None, '{"v":2}'),
        ("r", "a1", 1, "rejected", "rejected", "line\nbreak", "then", '{"v":1}'),
    ]
    found = _documents(
        spark, [("r", "WAITING", None, '{"llm_url":"x"}')], tasks, approvals,
        [("r", "e", "id", "t", "p", "f", "CLAIMED")], [("r", "j", "QUEUED", 0, 0, 3, 0, None)],
    )["r"]
    assert list(found) == [
        "run_id", "status", "failure_reason", "mode", "plan", "tasks", "results", "approvals", "approval_iteration",
        "active_approval_id", "rejected_revisions", "approval_count", "ingestion", "queue",
    ]
    assert [t["id"] for t in found["tasks"]] == ["planner", "quality_agent", "change_agent", "briefing_agent", "own_step"]
    assert found["tasks"][2]["error"] == 'bad "x"'
    assert found["results"] == {"quality_agent": {"a": 1}, "briefing_agent": {"v": 2}}
    assert [(a["id"], a["comment"], a["briefing"]) for a in found["approvals"]] == [
        ("a1", "line\nbreak", {"v": 1}), ("a2", None, {"v": 2}),
    ]
    assert (found["approval_iteration"], found["active_approval_id"], found["rejected_revisions"]) == (2, "a2", 1)
    assert (found["ingestion"]["status"], found["queue"]["max_attempts"], found["mode"]) == ("CLAIMED", 3, "model")
    assert list(found["plan"])[-1] == "revision_agent"


def test_a_bare_run_and_rows_of_no_run(spark):
    other = [("x", "planner", "succeeded", 1, None, "{}"), (None, "planner", "failed", 1, None, None)]
    found = _documents(spark, [("r", "PENDING", None, None)], other, events=[(None, "e", "id", "t", "p", "f", "INVALID")])["r"]
    assert (found["tasks"], found["results"], found["approvals"], found["ingestion"], found["queue"]) == ([], {}, [], None, None)
    assert (found["mode"], found["approval_iteration"], found["approval_count"]) == ("local", 0, 0)


def test_broken_outputs_and_long_histories(spark):
    approvals = [("r", f"a{n}", n, "rejected", None, None, None, "no json") for n in range(1, MAX_LISTED_APPROVALS + 31)]
    tasks = [("r", "quality_agent", "succeeded", 1, None, "{broken"), ("r", "briefing_agent", "succeeded", 1, None, '{"v":0}')]
    found = _documents(spark, [("r", "FAILED", 'a "b"', "no json")], tasks, approvals)["r"]
    assert found["results"] == {"briefing_agent": {"v": 0}}
    assert found["failure_reason"] == 'a "b"'
    assert len(found["approvals"]) == MAX_LISTED_APPROVALS
    assert found["approvals"][-1]["iteration"] == MAX_LISTED_APPROVALS
    assert (found["approval_count"], found["rejected_revisions"]) == (MAX_LISTED_APPROVALS + 30,) * 2
