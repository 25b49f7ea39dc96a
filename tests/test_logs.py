"""Literal run and delivery logs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tabwarden.operators import delivery as q
from tabwarden.operators import run_history as r

START = datetime(2024, 1, 1)
LOG = "id bigint, job_id string, event string, at_time timestamp_ntz, attempts_ago int"


def _log(spark, rows):
    return spark.createDataFrame(
        [(n, "j", event, START + timedelta(seconds=at), ago) for n, (at, event, ago) in enumerate(rows)], LOG
    )


def test_heartbeats_extend_until_one_is_late(spark):
    log = _log(spark, [(0, "claim", 0), (4, "heartbeat", 0), (8, "heartbeat", 0), (13, "heartbeat", 0), (14, "heartbeat", 0)])
    lease = q.effective_lease(log, 5).first()
    assert (lease.expires_at, lease.valid_beats, lease.void_beats) == (START + timedelta(seconds=13), 2, 2)


def test_stale_tokens_are_flagged_once(spark):
    log = _log(spark, [(0, "claim", 0), (6, "settle", 0), (7, "fail", 0), (8, "claim", 0), (9, "heartbeat", 1), (10, "settle", 0), (11, "settle", 0)])
    found = sorted((x.attempt, x.id, x.event) for x in q.stale_settlements(log, 5).collect())
    assert found == [(1, 1, "settle"), (2, 6, "settle")]


def test_delays_double_up_to_a_minute(spark):
    rows = [(n, "j", START, False, False, n, 0) for n in range(1, 14)]
    rows += [(20, "j", START, True, False, 3, 0), (21, "j", START, False, True, 3, 1)]
    frame = spark.createDataFrame(rows, "id bigint, job_id string, failed_at timestamp_ntz, expired boolean, busy boolean, budget_attempts int, delay_seconds int")
    delays = [x.expected_delay for x in q.backoff_audit(frame).orderBy("id").collect()]
    assert delays == [1, 2, 4, 8, 16, 32, 60, 60, 60, 60, 60, 60, 60, 0, 1]


def test_job_life_with_replay(spark):
    events = ["job_created", "job_claimed", "job_failed", "job_requeued", "job_claimed", "job_failed", "job_dead_lettered", "job_replayed", "job_claimed", "job_deferred", "job_requeued"]
    rows = [(n, "j", e, f"t{n:02d}", f"why {n}" if e in ("job_failed", "job_deferred") else None) for n, e in enumerate(events)]
    schema = "id bigint, job_id string, event string, logged_at string, error string"

    def state(count):
        return q.job_state_fold(spark.createDataFrame(rows[:count], schema)).first().asDict()

    dead = state(7)
    assert (dead["status"], dead["attempts"], dead["budget_attempts"], dead["last_error"], dead["dead_lettered_at"]) == ("DEAD_LETTER", 2, 2, "why 5", "t06")
    again = state(8)
    assert (again["status"], again["attempts"], again["budget_attempts"], again["replay_count"], again["last_error"]) == ("QUEUED", 2, 0, 1, None)
    busy = state(11)
    assert (busy["status"], busy["attempts"], busy["budget_attempts"], busy["last_error"], busy["started_at"]) == ("QUEUED", 3, 0, "why 9", "t01")


def test_backlog_order(spark):
    rows = [("a", "QUEUED", 0, 0, 3, "t1", "t1"), ("b", "QUEUED", 5, 0, 3, "t2", "t2"), ("c", "QUEUED", 5, 3, 3, "t0", "t0"), ("d", "QUEUED", 9, 0, 3, "t9", "t0"), ("e", "LEASED", 9, 0, 3, "t0", "t0"), ("f", "QUEUED", 5, 0, 3, "t1", "t3")]
    jobs = spark.createDataFrame(rows, "id string, status string, priority int, budget_attempts int, max_attempts int, available_at string, created_at string")
    assert [x.id for x in q.backlog_ranking(jobs, "t5", 10).collect()] == ["f", "b", "a"]


def test_blocking_goes_down_the_plan(spark):
    tasks = spark.createDataFrame(
        [("r", "planner", "succeeded", None), ("r", "quality_agent", "failed", "E: x"), ("r", "change_agent", "succeeded", None), ("r", "verifier", "pending", None), ("r", "briefing_agent", "pending", None), ("s", "planner", "succeeded", None)],
        "run_id string, task_id string, status string, error string",
    )
    assert {(x.task_id, tuple(x.unmet)) for x in r.blocked_tasks(tasks).collect()} == {("verifier", ("quality_agent",)), ("briefing_agent", ("verifier",))}
    assert {x.run_id: (x.status, x.failure_reason) for x in r.run_rollup(tasks).collect()} == {"r": ("FAILED", "E: x"), "s": ("SUCCEEDED", None)}


def test_retry_budget_starts_again_with_each_invocation(spark):
    def row(n, event, error=None):
        task = None if event == "run_resumed" else "t"
        return (n, "r", event, task, f'{{"error":"{error}"}}' if error else "{}")

    log = [row(0, "task_started"), row(1, "task_failed", "TimeoutError: a"), row(2, "task_retrying"), row(3, "task_started"), row(4, "task_failed", "TimeoutError: b"), row(5, "run_resumed"), row(6, "task_started"), row(7, "task_failed", "TimeoutError: c"), row(8, "run_resumed"), row(9, "task_started"), row(10, "task_failed", "ValueError: d")]
    frame = spark.createDataFrame(log, "id bigint, run_id string, event string, task string, detail_json string")
    found = [(x.id, x.expected, x.recorded) for x in r.retry_audit(frame).orderBy("id").collect()]
    assert found == [(1, True, True), (4, False, False), (7, True, False), (10, False, False)]


def test_only_the_first_usable_decision_counts(spark):
    requests = spark.createDataFrame([("a1", "r", 1, 0), ("a2", "r", 2, 50)], "approval_id string, run_id string, iteration bigint, requested_seq bigint")
    decisions = [(1, "a1", "rejected", " "), (2, "a1", "rejected", "fix"), (3, "a1", "approved", None), (10, "a2", "approved", None), (60, "a1", "approved", None), (61, "a2", "approved", None), (62, "zz", "approved", None)]
    found = r.decision_race(spark.createDataFrame(decisions, "seq bigint, approval_id string, decision string, comment string"), requests)
    assert {x.seq: x.outcome for x in found.collect()} == {
        1: "needs_comment", 2: "effective", 3: "already_decided", 10: "not_requested", 60: "superseded", 61: "effective", 62: "not_requested",
    }


def test_transition_report(spark):
    tasks = spark.createDataFrame([(x, "briefing_agent", "succeeded") for x in "abcde"] + [("f", "briefing_agent", "running")], "run_id string, task_id string, status string")
    approvals = spark.createDataFrame(
        [("b1", "b", 1, "pending"), ("c1", "c", 1, "rejected"), ("d1", "d", 1, "rejected"), ("d2", "d", 2, "rejected"), ("d3", "d", 3, "rejected"), ("e1", "e", 1, "approved")],
        "id string, run_id string, iteration bigint, status string",
    )
    configs = spark.createDataFrame([("c", '{"max_human_revisions":2}')], "run_id string, config_json string")
    found = {x.run_id: (x.action, x.next_iteration) for x in r.transition_report(tasks, approvals, configs).collect()}
    assert found == {"a": ("request", 1), "b": ("wait", None), "c": ("revise", 2), "d": ("fail_revision_limit", None), "e": ("succeed", None), "f": ("none", None)}
    assert [x.run_id for x in r.revision_limit(approvals, configs).filter(F.col("rejected") > 0).collect()] == ["d"]
