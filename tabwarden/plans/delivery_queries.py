"""Delivery queue (QUE) over tables derived from ``orders`` and logs derived from
``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import delivery as q
from tabwarden.plans.registry import query

CUTOFF = "1998-06-01T00:00:00.000000"
LEASE_SECONDS = 43_200
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_FORMAT = "'%Y-%m-%dT%H:%M:%S.%f'"

READY = f"""SELECT id, priority, available_at, created_at FROM job_rows WHERE status = 'QUEUED'
  AND available_at <= '{CUTOFF}' AND budget_attempts < max_attempts"""
NUMBERED = """SELECT *, current - attempts_ago AS attempt FROM (SELECT *,
  sum(CASE WHEN event = 'claim' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY id) AS current
  FROM delivery_log) AS counted"""
LEASES = f"""SELECT *, max(CASE WHEN event IN ('claim', 'heartbeat') THEN at_time + to_seconds({LEASE_SECONDS}) END) OVER w AS expiry,
  sum(CASE WHEN event = 'heartbeat' THEN 1 ELSE 0 END) OVER w AS beats,
  sum(CASE WHEN event IN ('fail', 'settle') THEN 1 ELSE 0 END) OVER w AS endings
FROM ({NUMBERED}) AS numbered WHERE attempt > 0
WINDOW w AS (PARTITION BY job_id, attempt ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
BREAKS = f"""SELECT *, min(CASE WHEN event = 'heartbeat'
    AND (at_time >= expiry OR endings > 0 OR attempt <> current) THEN id END)
  OVER (PARTITION BY job_id, attempt) AS broken FROM ({LEASES}) AS leases"""


@query("que_01_backlog_ranking", f"{READY} ORDER BY priority DESC, available_at, created_at, id LIMIT 100")
def _(t):
    """The next hundred jobs: the limit is the report."""
    ranked = q.backlog_ranking(t["job_rows"], CUTOFF, 100)
    return ranked.select("id", "priority", "available_at", "created_at")


@query(
    "que_02_expired_leases",
    f"SELECT id, lease_expires_at FROM job_rows WHERE status = 'LEASED' AND lease_expires_at <= '{CUTOFF}'",
)
def _(t):
    return q.expired_leases(t["job_rows"], CUTOFF).select("id", "lease_expires_at")


@query(
    "que_03_effective_lease",
    f"""SELECT job_id, CAST(attempt AS BIGINT) AS attempt,
  strftime(min(at_time) FILTER (event = 'claim'), {_FORMAT}) AS claimed_at,
  strftime(max(at_time + to_seconds({LEASE_SECONDS})) FILTER (broken IS NULL OR id < broken), {_FORMAT}) AS expires_at,
  count(*) FILTER (event = 'heartbeat' AND (broken IS NULL OR id < broken)) AS valid_beats,
  count(*) FILTER (event = 'heartbeat' AND id >= broken) AS void_beats
FROM ({BREAKS}) AS b WHERE event IN ('claim', 'heartbeat') GROUP BY job_id, attempt""",
)
def _(t):
    leases = q.effective_lease(t["delivery_log"], LEASE_SECONDS)
    return leases.select(
        "job_id",
        F.col("attempt").cast("bigint").alias("attempt"),
        *[F.date_format(name, _STAMP).alias(name) for name in ("claimed_at", "expires_at")],
        F.col("valid_beats").cast("bigint").alias("valid_beats"),
        F.col("void_beats").cast("bigint").alias("void_beats"),
    )


_EXPECTED = """CASE WHEN expired THEN 0 WHEN busy THEN 1
  ELSE least(60, CAST(pow(2, greatest(0, least(10, budget_attempts - 1))) AS BIGINT)) END"""


@query(
    "que_04_backoff_audit",
    f"""SELECT id, job_id, CAST(delay_seconds AS BIGINT) AS delay_seconds,
  CAST({_EXPECTED} AS BIGINT) AS expected_delay,
  strftime(failed_at + to_seconds({_EXPECTED}), {_FORMAT}) AS expected_available_at,
  delay_seconds = {_EXPECTED} AS agrees FROM failure_log""",
)
def _(t):
    audit = q.backoff_audit(t["failure_log"])
    stamp = F.date_format("expected_available_at", _STAMP)
    return audit.withColumn("expected_available_at", stamp).withColumn(
        "delay_seconds", F.col("delay_seconds").cast("bigint")
    )


@query(
    "que_05_outcome_audit",
    """SELECT id, expected_status, expected_outcome, CAST(budget_attempts - CASE WHEN busy THEN 1 ELSE 0 END AS BIGINT)
  AS expected_budget, NOT terminal AS replayable,
  expected_status = status_after AND expected_outcome = outcome AS agrees
FROM (SELECT *, CASE WHEN terminal OR (NOT busy AND budget_attempts >= max_attempts) THEN 'DEAD_LETTER'
  ELSE 'QUEUED' END AS expected_status, CASE WHEN expired THEN 'EXPIRED' WHEN busy THEN 'DEFERRED'
  ELSE 'FAILED' END AS expected_outcome FROM failure_log) AS derived""",
)
def _(t):
    return q.outcome_audit(t["failure_log"])


@query("que_06_dead_letters", "SELECT id, created_at, replayable FROM job_rows WHERE status = 'DEAD_LETTER'")
def _(t):
    return q.dead_letters(t["job_rows"]).select("id", "created_at", "replayable")


@query(
    "que_07_status_reconcile",
    f"""SELECT id, step, CASE step WHEN 'settle' THEN run_status WHEN 'terminal' THEN 'DEAD_LETTER'
    WHEN 'fail' THEN CASE WHEN budget_attempts >= max_attempts THEN 'DEAD_LETTER' ELSE 'QUEUED' END
    ELSE status END AS status,
  CASE WHEN step IN ('terminal', 'fail') THEN failure_reason WHEN step = 'keep' THEN last_error END AS last_error,
  CASE step WHEN 'terminal' THEN 'RevisionLimit' WHEN 'fail' THEN 'WorkflowFailure'
    WHEN 'keep' THEN last_error_type END AS last_error_type,
  CASE step WHEN 'terminal' THEN false WHEN 'fail' THEN true ELSE replayable END AS replayable
FROM (SELECT j.*, r.status AS run_status, r.failure_reason, CASE
  WHEN j.status = 'LEASED' AND j.lease_expires_at > '{CUTOFF}' THEN 'keep'
  WHEN r.status IN ('WAITING_FOR_APPROVAL', 'SUCCEEDED') THEN CASE WHEN j.status <> r.status THEN 'settle' ELSE 'keep' END
  WHEN r.status = 'FAILED' AND l.event = 'revision_limit_reached' THEN
    CASE WHEN j.status <> 'DEAD_LETTER' OR j.replayable THEN 'terminal' ELSE 'keep' END
  WHEN r.status = 'FAILED' AND j.status = 'WAITING_FOR_APPROVAL' THEN 'fail' ELSE 'keep' END AS step
FROM job_rows AS j JOIN run_rows AS r ON r.run_id = j.workflow_run_id
JOIN run_limits AS l ON l.run_id = j.workflow_run_id) AS steps""",
)
def _(t):
    return q.status_reconcile(t["job_rows"], t["run_rows"], t["run_limits"], CUTOFF)


def _attempts(t):
    claims = q.with_attempts(t["delivery_log"]).filter("event = 'claim'")
    return claims.select(
        "job_id",
        F.col("attempt").cast("bigint").alias("attempt_number"),
        "worker_id",
        F.date_format("at_time", _STAMP).alias("started_at"),
        F.sha2(F.concat_ws("-", "job_id", "attempt"), 256).alias("lease_token"),
    )


@query(
    "que_08_attempt_history",
    f"""SELECT job_id, CAST(attempt AS BIGINT) AS attempt_number, worker_id, strftime(at_time, {_FORMAT}) AS started_at
FROM ({NUMBERED}) AS numbered WHERE event = 'claim'""",
)
def _(t):
    return q.attempt_history(_attempts(t))


@query(
    "que_09_replay_generations",
    """SELECT job_id, generation, attempts, CAST(sum(attempts) OVER (PARTITION BY job_id ORDER BY generation) AS BIGINT)
  AS lifetime_attempts
FROM (SELECT job_id, CAST(generation AS BIGINT) AS generation, count(*) FILTER (event = 'claim') AS attempts
FROM (SELECT *, sum(CASE WHEN event = 'replay' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY id) AS generation
  FROM delivery_log) AS numbered GROUP BY job_id, generation) AS per_generation""",
)
def _(t):
    return q.replay_generations(t["delivery_log"])


@query("que_09_replay_allowed", "SELECT id FROM job_rows WHERE status = 'DEAD_LETTER' AND replayable")
def _(t):
    return q.replay_allowed(t["job_rows"]).select("id")


@query(
    "que_10_stale_settlements",
    f"""SELECT job_id, CAST(attempt AS BIGINT) AS attempt, min(id) AS id, arg_min(event, id) AS event
FROM ({LEASES}) AS leases WHERE event IN ('heartbeat', 'fail', 'settle')
  AND (attempt <> current OR at_time >= expiry OR endings > 0) GROUP BY job_id, attempt""",
)
def _(t):
    stale = q.stale_settlements(t["delivery_log"], LEASE_SECONDS)
    return stale.withColumn("attempt", F.col("attempt").cast("bigint"))


@query(
    "que_11_enqueue_dedup",
    """SELECT ingestion_id, min(seq) AS seq, arg_min(priority, seq) AS priority,
  arg_min(max_attempts, seq) AS max_attempts, count(*) - 1 AS existing FROM enqueue_log GROUP BY ingestion_id""",
)
def _(t):
    return q.enqueue_dedup(t["enqueue_log"])


@query(
    "que_12_job_state_fold",
    """SELECT job_id, status, attempts, budget_attempts, replay_count, CASE WHEN error_event IN ('job_failed', 'job_deferred')
    THEN last_error END AS last_error, created_at, started_at, updated_at,
  CASE WHEN status = 'SUCCEEDED' THEN last_at END AS completed_at,
  CASE WHEN status = 'DEAD_LETTER' THEN last_at END AS dead_lettered_at
FROM (SELECT job_id,
  CASE arg_max(event, id) FILTER (event <> 'job_failed') WHEN 'job_claimed' THEN 'LEASED'
    WHEN 'job_dead_lettered' THEN 'DEAD_LETTER' WHEN 'job_waiting_for_approval' THEN 'WAITING_FOR_APPROVAL'
    WHEN 'job_succeeded' THEN 'SUCCEEDED' ELSE 'QUEUED' END AS status,
  arg_max(logged_at, id) FILTER (event <> 'job_failed') AS last_at,
  count(*) FILTER (event = 'job_claimed') AS attempts,
  count(*) FILTER (event = 'job_claimed' AND generation = last_generation)
    - count(*) FILTER (event = 'job_deferred' AND generation = last_generation) AS budget_attempts,
  CAST(max(generation) AS BIGINT) AS replay_count,
  arg_max(event, id) FILTER (event IN ('job_failed', 'job_deferred', 'job_replayed', 'job_waiting_for_approval',
    'job_succeeded')) AS error_event,
  first(error ORDER BY id DESC) FILTER (event IN ('job_failed', 'job_deferred', 'job_replayed',
    'job_waiting_for_approval', 'job_succeeded')) AS last_error,
  min(logged_at) FILTER (event = 'job_created') AS created_at,
  min(logged_at) FILTER (event = 'job_claimed') AS started_at, max(logged_at) AS updated_at
FROM (SELECT *, max(generation) OVER (PARTITION BY job_id) AS last_generation FROM (SELECT *,
  sum(CASE WHEN event = 'job_replayed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY id) AS generation
  FROM job_log) AS g) AS numbered GROUP BY job_id) AS folded""",
)
def _(t):
    return q.job_state_fold(t["job_log"])


@query(
    "que_13_queue_integrity",
    """SELECT 'lease_matches_status' AS "check", count(*) FILTER ((status = 'LEASED' AND (lease_owner IS NULL
  OR lease_token IS NULL OR lease_expires_at IS NULL)) OR (status <> 'LEASED' AND (lease_owner IS NOT NULL
  OR lease_token IS NOT NULL OR lease_expires_at IS NOT NULL))) AS violations FROM job_rows
UNION ALL SELECT 'priority_in_range', count(*) FILTER (priority NOT BETWEEN -100 AND 100) FROM job_rows
UNION ALL SELECT 'max_attempts_in_range', count(*) FILTER (max_attempts NOT BETWEEN 1 AND 10) FROM job_rows
UNION ALL SELECT 'unique_attempt', count(*) FROM (SELECT job_id FROM delivery_log WHERE event = 'claim'
  GROUP BY job_id, k HAVING count(*) > 1) AS a
UNION ALL SELECT 'matches_reservation', count(*) FROM job_rows AS j WHERE NOT EXISTS (SELECT 1 FROM event_rows AS e
  WHERE e.id = j.ingestion_id AND e.workflow_run_id = j.workflow_run_id AND e.status <> 'INVALID')""",
)
def _(t):
    """Claims numbered by the value their event carries: some numbers repeat."""
    claims = t["delivery_log"].filter("event = 'claim'")
    attempts = claims.select("job_id", F.col("k").alias("attempt_number"))
    return q.queue_integrity(t["job_rows"], attempts, t["event_rows"])


@query("que_14_job_listing", "SELECT id, status, created_at FROM job_rows")
def _(t):
    return q.job_listing(t["job_rows"]).select("id", "status", "created_at")


@query(
    "que_15_job_linkage",
    """SELECT r.run_id, j.id AS job_id, j.status AS job_status, j.attempts, j.budget_attempts, j.max_attempts,
  j.replay_count, j.last_error
FROM run_rows AS r LEFT JOIN job_rows AS j ON j.workflow_run_id = r.run_id""",
)
def _(t):
    """Every run with its job, waiting ones too; runs without a job have NULLs."""
    return q.job_linkage(t["run_rows"], t["job_rows"])
