"""Run and approval history (RUN) over logs derived from ``events``,
``conversations`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import run_history as r
from tabwarden.plans.registry import query


@query(
    "run_01_run_listing",
    """SELECT run_id, upper(status) AS status, CASE WHEN json_extract_string(config_json, '$.llm_url') IS NULL
  THEN 'local' ELSE 'model' END AS mode, created_at FROM run_rows""",
)
def _(t):
    return r.run_listing(t["run_rows"])


@query(
    "run_02_task_outputs",
    """SELECT run_id, task_id, output_json FROM task_rows
WHERE status = 'succeeded' AND output_json IS NOT NULL""",
)
def _(t):
    return r.task_outputs(t["task_rows"])


@query(
    "run_03_task_attempts",
    """SELECT run_id, task, count(*) FILTER (event = 'task_started') AS starts,
  count(*) FILTER (event = 'task_failed') AS failures, count(*) FILTER (event = 'task_retrying') AS retries,
  count(*) FILTER (event = 'task_reused') AS reuses, count(*) FILTER (event = 'task_recovered') AS recoveries
FROM run_log WHERE task IS NOT NULL GROUP BY run_id, task""",
)
def _(t):
    return r.task_attempts(t["run_log"])


@query(
    "run_04_blocked_tasks",
    """SELECT p.run_id, p.task_id, string_agg(e.needs, '|' ORDER BY e.place) AS unmet
FROM task_rows AS p JOIN (VALUES ('quality_agent', 'planner', 1), ('change_agent', 'planner', 1),
  ('verifier', 'quality_agent', 1), ('verifier', 'change_agent', 2), ('briefing_agent', 'verifier', 1))
  AS e(task_id, needs, place) ON e.task_id = p.task_id
LEFT JOIN task_rows AS d ON d.run_id = p.run_id AND d.task_id = e.needs
WHERE p.status = 'pending' AND coalesce(d.status, '') <> 'succeeded' GROUP BY p.run_id, p.task_id""",
)
def _(t):
    blocked = r.blocked_tasks(t["task_rows"])
    return blocked.select("run_id", "task_id", F.array_join("unmet", "|").alias("unmet"))


ORDERED = """list_position(['planner', 'quality_agent', 'change_agent', 'verifier', 'briefing_agent'], task_id)"""


@query(
    "run_05_run_rollup",
    f"""SELECT run_id, CASE WHEN bool_and(status = 'succeeded') THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
  CASE WHEN NOT bool_and(status = 'succeeded') THEN coalesce(string_agg(error, '; ' ORDER BY {ORDERED})
    FILTER (status = 'failed'), '') END AS failure_reason
FROM task_rows GROUP BY run_id""",
)
def _(t):
    return r.run_rollup(t["task_rows"])


@query(
    "run_06_retry_audit",
    """SELECT id, run_id, task, expected, recorded, expected = recorded AS agrees FROM (
SELECT id, run_id, task, event, k % 3 < 2 AND attempts_used < 2 AS expected,
  coalesce(next_event = 'task_retrying', false) AS recorded FROM (
SELECT *, sum(CASE WHEN event = 'task_started' THEN 1 ELSE 0 END)
    OVER (PARTITION BY run_id, task, invocation ORDER BY id) AS attempts_used,
  lead(event) OVER (PARTITION BY run_id, task ORDER BY id) AS next_event FROM (
SELECT *, sum(CASE WHEN event = 'run_resumed' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY id) AS invocation
FROM run_log) AS numbered WHERE task IS NOT NULL) AS counted) AS judged WHERE event = 'task_failed'""",
)
def _(t):
    return r.retry_audit(t["run_log"])


@query(
    "run_07_run_timeline",
    """SELECT run_id, id, event, task, logged_at, json_extract_string(detail_json, '$.attempt') AS attempt,
  json_extract_string(detail_json, '$.error') AS error FROM run_log""",
)
def _(t):
    timeline = r.run_timeline(t["run_log"])
    detail = F.col("detail")
    return timeline.select(
        "run_id", "id", "event", "task", "logged_at",
        detail["attempt"].alias("attempt"), detail["error"].alias("error"),
    )


@query("run_08_approval_history", "SELECT id, run_id, iteration, status, decision, comment FROM approval_rows")
def _(t):
    history = r.approval_history(t["approval_rows"])
    return history.select("id", "run_id", "iteration", "status", "decision", "comment")


STATE = """SELECT run_id, max(iteration) AS iteration, arg_max(status, iteration) AS latest_status,
  arg_max(id, iteration) AS latest_id, min(id) FILTER (status = 'pending') AS pending_id,
  count(*) FILTER (status = 'rejected') AS rejected FROM approval_rows GROUP BY run_id"""
LIMITS = """SELECT run_id, coalesce(CAST(json_extract_string(config_json, '$.max_human_revisions') AS BIGINT), 3)
  AS revision_limit FROM run_configs"""


@query("run_09_approval_state", STATE)
def _(t):
    return r.approval_state(t["approval_rows"])


@query(
    "run_10_transition_report",
    f"""SELECT run_id, action, CASE action WHEN 'request' THEN CAST(1 AS BIGINT) WHEN 'revise' THEN iteration + 1 END
  AS next_iteration FROM (SELECT t.run_id, s.iteration, CASE WHEN NOT t.briefed THEN 'none'
  WHEN s.run_id IS NULL THEN 'request' WHEN latest_status = 'approved' THEN 'succeed'
  WHEN latest_status = 'pending' THEN 'wait' WHEN rejected >= coalesce(revision_limit, 3) THEN 'fail_revision_limit'
  ELSE 'revise' END AS action
FROM (SELECT run_id, bool_or(task_id = 'briefing_agent' AND status = 'succeeded') AS briefed
  FROM task_rows GROUP BY run_id) AS t LEFT JOIN ({STATE}) AS s ON s.run_id = t.run_id
LEFT JOIN ({LIMITS}) AS l ON l.run_id = t.run_id) AS actions""",
)
def _(t):
    return r.transition_report(t["task_rows"], t["approval_rows"], t["run_configs"])


@query(
    "run_11_revision_limit",
    f"""SELECT s.run_id, rejected, coalesce(revision_limit, 3) AS revision_limit FROM ({STATE}) AS s
LEFT JOIN ({LIMITS}) AS l ON l.run_id = s.run_id WHERE rejected >= coalesce(revision_limit, 3)""",
)
def _(t):
    return r.revision_limit(t["approval_rows"], t["run_configs"])


@query(
    "run_12_approval_integrity",
    """SELECT 'decision_matches_status' AS "check", count(*) FILTER (NOT coalesce((status = 'pending'
  AND decision IS NULL AND decided_at IS NULL) OR (status <> 'pending' AND decision = status
  AND decided_at IS NOT NULL), false)) AS violations FROM approval_rows
UNION ALL SELECT 'positive_iteration', count(*) FILTER (iteration <= 0) FROM approval_rows
UNION ALL SELECT 'one_pending_per_run', count(*) FROM (SELECT run_id FROM approval_rows WHERE status = 'pending'
  GROUP BY run_id HAVING count(*) > 1) AS a
UNION ALL SELECT 'unique_version', count(*) FROM (SELECT run_id FROM approval_rows GROUP BY run_id, iteration
  HAVING count(*) > 1) AS b
UNION ALL SELECT 'immutable_briefing', count(*) FROM (SELECT run_id FROM approval_rows GROUP BY run_id
  HAVING count(DISTINCT comment) > 1) AS c""",
)
def _(t):
    """The texts of one conversation serve as logged versions of one briefing."""
    approvals = t["approval_rows"]
    versions = approvals.select(F.col("run_id").alias("id"), F.col("comment").alias("briefing_json"))
    return r.approval_integrity(approvals, versions)


@query(
    "run_13_decision_race",
    """SELECT seq, approval_id, decision, coalesce(problem, CASE WHEN seq = min(CASE WHEN problem IS NULL THEN seq END)
  OVER (PARTITION BY approval_id) THEN 'effective' ELSE 'already_decided' END) AS outcome
FROM (SELECT d.seq, d.approval_id, d.decision, CASE
  WHEN d.decision = 'rejected' AND trim(coalesce(d.comment, '')) = '' THEN 'needs_comment'
  WHEN q.requested_seq IS NULL OR d.seq < q.requested_seq THEN 'not_requested'
  WHEN d.seq > q.closed_seq THEN 'superseded' END AS problem
FROM decision_log AS d LEFT JOIN (SELECT *, lead(requested_seq) OVER (PARTITION BY run_id ORDER BY iteration)
  AS closed_seq FROM approval_requests) AS q ON q.approval_id = d.approval_id) AS judged""",
)
def _(t):
    return r.decision_race(t["decision_log"], t["approval_requests"])


@query(
    "run_14_run_stats",
    """SELECT run_id, count(*) FILTER (status = 'succeeded') AS steps_succeeded, count(*) AS steps,
  CAST(sum(attempts) AS BIGINT) AS attempts,
  max(attempts) FILTER (task_id = 'quality_agent' AND status = 'succeeded') AS issues,
  max(attempts) FILTER (task_id = 'change_agent' AND status = 'succeeded') AS changes
FROM task_rows GROUP BY run_id""",
)
def _(t):
    return r.run_stats(t["task_rows"])


def _quoted(name: str) -> str:
    return f"coalesce(CAST(to_json({name}) AS VARCHAR), 'null')"


def _object(*fields: str) -> str:
    parts = ", ',', ".join(f"'\"{name.split('.')[-1]}\":', {_quoted(name)}" for name in fields)
    return f"concat('{{', {parts}, '}}')"


_BRIEFING = "CASE WHEN json_valid(briefing_json) THEN briefing_json ELSE 'null' END"
_PLAN = (
    '{"planner":[],"quality_agent":["planner"],"change_agent":["planner"],"verifier":["quality_agent","change_agent"],'
    '"briefing_agent":["verifier"],"approval_gate":["briefing_agent"],"revision_agent":["approval_gate:rejected"]}'
)


@query(
    "run_15_run_document",
    f"""SELECT h.run_id, concat('{{"run_id":"', h.run_id, '","status":"', h.status, '","failure_reason":', {_quoted("h.failure_reason")},
  ',"mode":"', CASE WHEN coalesce(json_extract_string(h.config_json, '$.llm_url'), '') <> '' THEN 'model' ELSE 'local' END,
  '","plan":{_PLAN},"tasks":[', coalesce(t.tasks, ''), '],"results":{{', concat_ws(',', t.results, coalesce(a.latest, t.briefing)),
  '}},"approvals":[', coalesce(a.listed, ''), '],"approval_iteration":', coalesce(a.iteration, 0), ',"active_approval_id":',
  {_quoted("a.pending_id")}, ',"rejected_revisions":', coalesce(a.rejected, 0), ',"approval_count":', coalesce(a.n, 0),
  ',"ingestion":', coalesce(e.body, 'null'), ',"queue":', coalesce(j.body, 'null'), '}}') AS document
FROM run_heads AS h
LEFT JOIN (SELECT run_id, string_agg({_object("id", "status", "attempts", "error")}, ',' ORDER BY place) AS tasks,
    string_agg(concat('"', id, '":', output_json), ',' ORDER BY place)
      FILTER (status = 'succeeded' AND id IN ('quality_agent', 'change_agent')) AS results,
    min(concat('"briefing_agent":', output_json)) FILTER (status = 'succeeded' AND id = 'briefing_agent') AS briefing
  FROM (SELECT *, task_id AS id, {ORDERED} AS place FROM task_rows) AS placed GROUP BY run_id) AS t ON t.run_id = h.run_id
LEFT JOIN (SELECT run_id, max(iteration) AS iteration, min(id) FILTER (status = 'pending') AS pending_id,
    count(*) FILTER (status = 'rejected') AS rejected, count(*) AS n,
    CASE WHEN json_valid(arg_max(briefing_json, iteration)) THEN concat('"briefing_agent":', arg_max(briefing_json, iteration)) END AS latest,
    string_agg(concat(rtrim({_object("id", "iteration", "status", "decision", "comment", "decided_at")}, '}}'),
      ',"briefing":', {_BRIEFING}, '}}'), ',' ORDER BY iteration, id) FILTER (place <= 100) AS listed
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iteration, id) AS place FROM briefed_approvals) AS ranked
  GROUP BY run_id) AS a ON a.run_id = h.run_id
LEFT JOIN (SELECT workflow_run_id, {_object("id", "event_id", "event_type", "manifest_path", "fingerprint", "status")} AS body
  FROM head_events) AS e ON e.workflow_run_id = h.run_id
LEFT JOIN (SELECT workflow_run_id, {_object("id", "status", "attempts", "budget_attempts", "max_attempts", "replay_count", "last_error")} AS body
  FROM head_jobs) AS j ON j.workflow_run_id = h.run_id""",
)
def _(t):
    """Runs of all customers with every section."""
    return r.run_document(t["run_heads"], t["task_rows"], t["briefed_approvals"], t["head_events"], t["head_jobs"])
