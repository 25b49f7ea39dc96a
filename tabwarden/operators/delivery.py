"""Reports and audits over the tables and logs of a delivery queue.

Times are compared as given; the moment a report speaks about is always an
argument, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.hotkeys import Running, running
from tabwarden.operators.submissions import limited_runs

# Bounds and delays of the queue.
PRIORITY_RANGE = (-100, 100)
ATTEMPTS_RANGE = (1, 10)
MAX_DELAY_SECONDS = 60
BUSY_DELAY_SECONDS = 1
MAX_DOUBLINGS = 10

# The state each logged event leaves a job in.
STATE_AFTER = {
    "job_created": "QUEUED",
    "job_claimed": "LEASED",
    "job_requeued": "QUEUED",
    "job_deferred": "QUEUED",
    "job_dead_lettered": "DEAD_LETTER",
    "job_replayed": "QUEUED",
    "job_waiting_for_approval": "WAITING_FOR_APPROVAL",
    "job_succeeded": "SUCCEEDED",
}
SETS_ERROR = ("job_failed", "job_deferred", "lease_expired")
CLEARS_ERROR = ("job_replayed", "job_waiting_for_approval", "job_succeeded")


def backlog_ranking(jobs: DataFrame, cutoff: str, k: int) -> DataFrame:
    """The ``k`` jobs to be claimed next at ``cutoff``."""
    ready = (
        (F.col("status") == "QUEUED")
        & (F.col("available_at") <= cutoff)
        & (F.col("budget_attempts") < F.col("max_attempts"))
    )
    order = (F.desc("priority"), "available_at", "created_at", "id")
    return jobs.filter(ready).orderBy(*order).limit(k)


def expired_leases(jobs: DataFrame, cutoff: str) -> DataFrame:
    return jobs.filter((F.col("status") == "LEASED") & (F.col("lease_expires_at") <= cutoff))


def with_attempts(log: DataFrame) -> DataFrame:
    """Number the claims of each job; ``attempt`` is the one a row speaks for,
    ``current`` the latest one claimed so far."""
    claimed = F.when(F.col("event") == "claim", 1).otherwise(0)
    numbered = running(log, ["job_id"], "id", {"current": Running(claimed)})
    return numbered.withColumn("attempt", F.col("current") - F.col("attempts_ago"))


def _lease_rows(log: DataFrame, lease_seconds: int) -> DataFrame:
    """Per attempt, the expiry and the number of beats and endings before each row.

    The running maximum counts every earlier beat. Up to the first beat that came
    too late all beats are good, so it is exact until then, and nothing after
    that matters.
    """
    numbered = with_attempts(log).filter("attempt > 0")
    until = F.col("at_time") + F.make_dt_interval(secs=F.lit(lease_seconds))
    extends = F.col("event").isin("claim", "heartbeat")
    ends = F.col("event").isin("fail", "settle")
    specs = {
        "expiry": Running(F.when(extends, until), "max", inclusive=False),
        "beats": Running(F.when(F.col("event") == "heartbeat", 1).otherwise(0), inclusive=False),
        "endings": Running(F.when(ends, 1).otherwise(0), inclusive=False),
    }
    return running(numbered, ["job_id", "attempt"], "id", specs).withColumn("until", until)


def effective_lease(log: DataFrame, lease_seconds: int) -> DataFrame:
    """When each attempt's lease ran out after its heartbeats.

    A beat is void at or after the running expiry, after the attempt failed or was
    settled, or once a newer claim holds the job; so is every beat after it.
    """
    rows = _lease_rows(log, lease_seconds).filter(F.col("event").isin("claim", "heartbeat"))
    lost = (F.col("at_time") >= F.col("expiry")) | (F.col("endings") > 0) | (F.col("attempt") != F.col("current"))
    late = (F.col("event") == "heartbeat") & lost
    state = F.struct("expiry", "beats")
    leases = rows.groupBy("job_id", "attempt").agg(
        F.min(F.when(F.col("event") == "claim", F.col("at_time"))).alias("claimed_at"),
        F.min_by(state, F.when(late, F.col("id"))).alias("broken"),
        F.max("until").alias("last_until"),
        F.count_if(F.col("event") == "heartbeat").alias("beats"),
    )
    valid = F.coalesce("broken.beats", "beats")
    return leases.select(
        "job_id",
        "attempt",
        "claimed_at",
        F.coalesce("broken.expiry", "last_until").alias("expires_at"),
        valid.alias("valid_beats"),
        (F.col("beats") - valid).alias("void_beats"),
    )


def stale_settlements(log: DataFrame, lease_seconds: int) -> DataFrame:
    """The first row of each attempt that spoke without holding the lease:
    another attempt was current, the lease had run out, or it had been given up."""
    rows = _lease_rows(log, lease_seconds).filter(F.col("event").isin("heartbeat", "fail", "settle"))
    lost = (
        (F.col("attempt") != F.col("current"))
        | (F.col("at_time") >= F.col("expiry"))
        | (F.col("endings") > 0)
    )
    return (
        rows.filter(lost)
        .groupBy("job_id", "attempt")
        .agg(F.min("id").alias("id"), F.min_by("event", "id").alias("event"))
    )


def expected_delay(expired: Column, busy: Column, budget: Column) -> Column:
    doublings = F.greatest(F.lit(0), F.least(F.lit(MAX_DOUBLINGS), budget - 1))
    delay = F.least(F.lit(MAX_DELAY_SECONDS), F.pow(F.lit(2), doublings)).cast("bigint")
    return F.when(expired, 0).when(busy, BUSY_DELAY_SECONDS).otherwise(delay).cast("bigint")


def backoff_audit(failures: DataFrame) -> DataFrame:
    """Recorded against expected delay, and the time a job becomes available."""
    expected = expected_delay(F.col("expired"), F.col("busy"), F.col("budget_attempts"))
    available = F.col("failed_at") + F.make_dt_interval(secs=F.col("expected_delay"))
    return failures.select("*", expected.alias("expected_delay")).select(
        "id",
        "job_id",
        "delay_seconds",
        "expected_delay",
        available.alias("expected_available_at"),
        (F.col("delay_seconds") == F.col("expected_delay")).alias("agrees"),
    )


def outcome_audit(failures: DataFrame) -> DataFrame:
    """Recorded against derived outcome of each failed attempt."""
    dead = F.col("terminal") | (~F.col("busy") & (F.col("budget_attempts") >= F.col("max_attempts")))
    status = F.when(dead, "DEAD_LETTER").otherwise("QUEUED")
    outcome = F.when(F.col("expired"), "EXPIRED").when(F.col("busy"), "DEFERRED").otherwise("FAILED")
    refunded = F.col("budget_attempts") - F.when(F.col("busy"), 1).otherwise(0)
    return failures.select(
        "id",
        status.alias("expected_status"),
        outcome.alias("expected_outcome"),
        refunded.cast("bigint").alias("expected_budget"),
        (~F.col("terminal")).alias("replayable"),
        ((status == F.col("status_after")) & (outcome == F.col("outcome"))).alias("agrees"),
    )


def dead_letters(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'DEAD_LETTER'").orderBy("created_at", "id")


def status_reconcile(
    jobs: DataFrame, runs: DataFrame, run_events: DataFrame, cutoff: str | None = None
) -> DataFrame:
    """Job states as their runs imply them. Leases unexpired at ``cutoff`` (all
    leases, if none is given) are left alone."""
    run = runs.select(
        F.col("run_id").alias("workflow_run_id"), F.col("status").alias("run_status"), "failure_reason"
    )
    limits = limited_runs(run_events).withColumnRenamed("run_id", "workflow_run_id")
    joined = jobs.join(run, "workflow_run_id", "left").join(limits, "workflow_run_id", "left")
    held = F.col("status") == "LEASED"
    if cutoff is not None:
        held = held & (F.col("lease_expires_at") > cutoff)
    run_status, status = F.col("run_status"), F.col("status")
    limited = (run_status == "FAILED") & F.col("limited").isNotNull()
    terminal = limited & ((status != "DEAD_LETTER") | F.col("replayable"))
    failed = (run_status == "FAILED") & (status == "WAITING_FOR_APPROVAL") & ~limited
    spent = F.col("budget_attempts") >= F.col("max_attempts")
    step = F.coalesce(
        F.when(run_status.isNull() | held, "keep"),
        F.when(run_status.isin("WAITING_FOR_APPROVAL", "SUCCEEDED") & (status != run_status), "settle"),
        F.when(terminal, "terminal"),
        F.when(failed, "fail"),
        F.lit("keep"),
    )
    reason = {
        "terminal": F.coalesce("failure_reason", F.lit("Human revision limit reached.")),
        "fail": F.coalesce("failure_reason", F.lit("Human revision failed.")),
    }
    return joined.select("*", step.alias("step")).select(
        "id",
        "step",
        F.when(F.col("step") == "settle", run_status)
        .when(F.col("step") == "terminal", "DEAD_LETTER")
        .when(F.col("step") == "fail", F.when(spent, "DEAD_LETTER").otherwise("QUEUED"))
        .otherwise(status)
        .alias("status"),
        F.when(F.col("step") == "terminal", reason["terminal"])
        .when(F.col("step") == "fail", reason["fail"])
        .when(F.col("step") == "keep", F.col("last_error"))
        .alias("last_error"),
        F.when(F.col("step") == "terminal", "RevisionLimit")
        .when(F.col("step") == "fail", "WorkflowFailure")
        .when(F.col("step") == "keep", F.col("last_error_type"))
        .alias("last_error_type"),
        F.when(F.col("step") == "terminal", False)
        .when(F.col("step") == "fail", True)
        .otherwise(F.col("replayable"))
        .alias("replayable"),
    )


def attempt_history(attempts: DataFrame) -> DataFrame:
    """Attempts in order of job and number, without the lease token."""
    return attempts.drop("lease_token").orderBy("job_id", "attempt_number")


def replay_generations(log: DataFrame) -> DataFrame:
    """Attempts per job and replay generation. Lifetime attempts go on counting
    while the budget starts again with each generation."""
    replayed = F.when(F.col("event") == "replay", 1).otherwise(0)
    numbered = running(log, ["job_id"], "id", {"generation": Running(replayed)})
    per = numbered.groupBy("job_id", "generation").agg(
        F.count_if(F.col("event") == "claim").alias("attempts")
    )
    return running(per, ["job_id"], "generation", {"lifetime_attempts": Running(F.col("attempts"))})


def replay_allowed(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "DEAD_LETTER") & F.col("replayable"))


def enqueue_dedup(log: DataFrame) -> DataFrame:
    """One job per event with its first priority and budget, and how many later
    submissions found it there."""
    first = F.struct("seq", "priority", "max_attempts")
    jobs = log.groupBy("ingestion_id").agg(
        F.min_by(first, "seq").alias("first"), (F.count(F.lit(1)) - 1).alias("existing")
    )
    return jobs.select("ingestion_id", "first.seq", "first.priority", "first.max_attempts", "existing")


def job_state_fold(log: DataFrame) -> DataFrame:
    """The current row of every job from its accepted history.

    Every column is an aggregate: the last event that decides it, a count, or a
    count within the last replay generation. Nothing is folded in one task.
    """
    replayed = F.when(F.col("event") == "job_replayed", 1).otherwise(0)
    numbered = running(log, ["job_id"], "id", {"generation": Running(replayed)})
    event, at = F.col("event"), F.col("logged_at")
    states = F.create_map(*[F.lit(x) for pair in STATE_AFTER.items() for x in pair])
    state = states[event]
    last_id = F.when(state.isNotNull(), F.col("id"))
    error = F.struct(F.when(event.isin(*SETS_ERROR), F.col("error")).alias("error"))
    error_id = F.when(event.isin(*SETS_ERROR, *CLEARS_ERROR), F.col("id"))
    per = numbered.groupBy("job_id", "generation").agg(
        F.count_if(event == "job_claimed").alias("attempts"),
        F.count_if(event == "job_deferred").alias("refunds"),
        F.max_by(F.struct(state.alias("state"), F.col("id"), at.alias("at")), last_id).alias("last"),
        F.max(last_id).alias("last_id"),
        F.max_by(error, error_id).alias("error"),
        F.max(error_id).alias("error_id"),
        F.min(F.when(event == "job_created", at)).alias("created_at"),
        F.min(F.when(event == "job_claimed", at)).alias("started_at"),
        F.max(at).alias("updated_at"),
    )
    jobs = per.groupBy("job_id").agg(
        F.max_by("last", "last_id").alias("last"),
        F.sum("attempts").alias("attempts"),
        F.max_by(F.col("attempts") - F.col("refunds"), "generation").alias("budget_attempts"),
        F.max("generation").alias("replay_count"),
        F.max_by("error", "error_id").alias("error"),
        F.min("created_at").alias("created_at"),
        F.min("started_at").alias("started_at"),
        F.max("updated_at").alias("updated_at"),
    )
    status = F.col("last.state")
    return jobs.select(
        "job_id",
        status.alias("status"),
        "attempts",
        "budget_attempts",
        "replay_count",
        F.col("error.error").alias("last_error"),
        "created_at",
        "started_at",
        "updated_at",
        F.when(status == "SUCCEEDED", F.col("last.at")).alias("completed_at"),
        F.when(status == "DEAD_LETTER", F.col("last.at")).alias("dead_lettered_at"),
    )


def queue_integrity(jobs: DataFrame, attempts: DataFrame, events: DataFrame) -> DataFrame:
    """Violations per invariant of the queue tables."""
    lease = [F.col(name).isNotNull() for name in ("lease_owner", "lease_token", "lease_expires_at")]
    all_set, any_set = lease[0] & lease[1] & lease[2], lease[0] | lease[1] | lease[2]
    leased = F.col("status") == "LEASED"
    rows = {
        "lease_matches_status": (leased & ~all_set) | (~leased & any_set),
        "priority_in_range": ~F.col("priority").between(*PRIORITY_RANGE),
        "max_attempts_in_range": ~F.col("max_attempts").between(*ATTEMPTS_RANGE),
    }
    counted = jobs.agg(*[F.count_if(broken).alias(name) for name, broken in rows.items()])
    entries = F.array(
        *[F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in rows]
    )
    per_attempt = attempts.groupBy("job_id", "attempt_number").agg(F.count(F.lit(1)).alias("n"))
    reserved = events.filter("status <> 'INVALID'").select(
        F.col("id").alias("ingestion_id"), "workflow_run_id"
    )
    orphans = jobs.join(reserved, ["ingestion_id", "workflow_run_id"], "left_anti")

    def result(df: DataFrame, check: str, count: Column) -> DataFrame:
        return df.agg(count.alias("violations")).select(F.lit(check).alias("check"), "violations")

    return (
        counted.select(F.explode(entries).alias("e"))
        .select("e.*")
        .unionByName(result(per_attempt, "unique_attempt", F.count_if(F.col("n") > 1)))
        .unionByName(result(orphans, "matches_reservation", F.count(F.lit(1))))
    )


def job_listing(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("created_at", "id")


def job_linkage(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue details of every run; NULLs for a run without a job."""
    details = jobs.select(
        F.col("workflow_run_id").alias("run_id"),
        F.col("id").alias("job_id"),
        F.col("status").alias("job_status"),
        "attempts",
        "budget_attempts",
        "max_attempts",
        "replay_count",
        "last_error",
    )
    return runs.select("run_id").join(details, "run_id", "left")
