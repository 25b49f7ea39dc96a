"""Reports and audits over logged runs: tasks, events and approvals.

Every result is derived from append-only rows; nothing here drives an execution.
Logs of one run can be long, so running counts use segmented windows and
histories stay in long form.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.hotkeys import Running, join_per_key, neighbour, running
from tabwarden.functions.text import strip

# The steps of a run in order, and what each waits for.
PLAN = {
    "planner": (),
    "quality_agent": ("planner",),
    "change_agent": ("planner",),
    "verifier": ("quality_agent", "change_agent"),
    "briefing_agent": ("verifier",),
}

# The plan as run documents show it, the tasks whose results they hold,
# and what they tell of a run's event and job.
DOCUMENT_PLAN = {
    **{task: list(needed) for task, needed in PLAN.items()},
    "approval_gate": ["briefing_agent"],
    "revision_agent": ["approval_gate:rejected"],
}
RESULT_TASKS = ("quality_agent", "change_agent", "briefing_agent")
INGESTION_FIELDS = ("id", "event_id", "event_type", "manifest_path", "fingerprint", "status")
QUEUE_FIELDS = ("id", "status", "attempts", "budget_attempts", "max_attempts", "replay_count", "last_error")

#: Approvals that a run document lists; a run of the usual limits has four at most.
MAX_LISTED_APPROVALS = 100

# Failures that may be tried again, and the usual limits.
RETRYABLE_ERRORS = (
    "BrokenPipeError",
    "ConnectionAbortedError",
    "ConnectionError",
    "ConnectionRefusedError",
    "ConnectionResetError",
    "TimeoutError",
    "TransientTaskError",
    "TransportError",
)
DEFAULT_MAX_ATTEMPTS = 2
DEFAULT_MAX_REVISIONS = 3


def _plan_position(task: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in PLAN]), task)


def run_listing(runs: DataFrame) -> DataFrame:
    """Newest first, ties by id. A run is in model mode if a model address is set."""
    address = F.get_json_object("config_json", "$.llm_url")
    mode = F.when(address.isNotNull() & (address != ""), "model").otherwise("local")
    listed = runs.select("run_id", F.upper("status").alias("status"), mode.alias("mode"), "created_at")
    return listed.orderBy(F.desc("created_at"), "run_id")


def task_outputs(tasks: DataFrame) -> DataFrame:
    done = tasks.filter((F.col("status") == "succeeded") & F.col("output_json").isNotNull())
    return done.select("run_id", "task_id", "output_json")


def task_attempts(log: DataFrame) -> DataFrame:
    """Lifetime counts per run and task from the event log."""
    events = {
        "starts": "task_started",
        "failures": "task_failed",
        "retries": "task_retrying",
        "reuses": "task_reused",
        "recoveries": "task_recovered",
    }
    of_tasks = log.filter(F.col("task").isNotNull())
    counts = [F.count_if(F.col("event") == event).alias(name) for name, event in events.items()]
    return of_tasks.groupBy("run_id", "task").agg(*counts)


def blocked_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks with the dependencies that did not succeed, in plan order.

    A dependency that is itself blocked did not succeed either, so one step of
    the plan carries blocking along the whole chain.
    """
    statuses = tasks.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("task_id", "status"))).alias("statuses")
    )
    return _blocked(tasks.filter("status = 'pending'").join(statuses, "run_id"))


def _blocked(pending: DataFrame) -> DataFrame:
    waits = F.lit(None).cast("array<string>")
    for task, needed in PLAN.items():
        unmet = F.array_compact(
            F.array(
                *[
                    F.when(
                        F.coalesce(F.col("statuses")[F.lit(name)], F.lit("")) != "succeeded",
                        F.lit(name),
                    )
                    for name in needed
                ]
            ).cast("array<string>")
        )
        waits = F.when(F.col("task_id") == task, unmet).otherwise(waits)
    waiting = pending.select("run_id", "task_id", waits.alias("unmet"))
    return waiting.filter(F.size("unmet") > 0)


def run_rollup(tasks: DataFrame) -> DataFrame:
    """FAILED unless every task succeeded, with the errors of failed tasks.

    Only the steps of the plan count, not gates or revisions recorded beside them. A
    run has as many tasks as its plan, so collecting their errors is bounded.
    """
    tasks = tasks.filter(_plan_position(F.col("task_id")) > 0)
    error = F.when(
        F.col("status") == "failed",
        F.struct(_plan_position(F.col("task_id")).alias("place"), F.col("error").alias("error")),
    )
    grouped = tasks.groupBy("run_id").agg(
        F.bool_and(F.col("status") == "succeeded").alias("done"),
        F.array_sort(F.collect_list(error)).alias("errors"),
    )
    reason = F.array_join(F.col("errors.error"), "; ")
    return grouped.select(
        "run_id",
        F.when(F.col("done"), "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.when(~F.col("done"), reason).alias("failure_reason"),
    )


def retry_audit(log: DataFrame, max_attempts: int = DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """Per logged failure, whether a retry was due and whether one was logged.

    A retry is due for a retryable error while attempts remain in the current
    invocation; an invocation starts when the run is created or resumed. Whether an
    error is retryable is read from the log; its class decides where the log is silent.
    """
    resumed = F.when(F.col("event") == "run_resumed", 1).otherwise(0)
    numbered = running(log, ["run_id"], "id", {"invocation": Running(resumed)})
    of_tasks = numbered.filter(F.col("task").isNotNull())
    started = F.when(F.col("event") == "task_started", 1).otherwise(0)
    keys = ["run_id", "task", "invocation"]
    counted = running(of_tasks, keys, "id", {"attempts_used": Running(started)})
    followed = neighbour(counted, ["run_id", "task"], "id", {"next_event": "event"}, forward=True)
    kind = F.substring_index(F.get_json_object("detail_json", "$.error"), ":", 1)
    flag = F.get_json_object("detail_json", "$.retryable")
    retryable = F.when(flag.isin("true", "false"), flag == "true").otherwise(kind.isin(*RETRYABLE_ERRORS))
    expected = retryable & (F.col("attempts_used") < max_attempts)
    recorded = F.coalesce(F.col("next_event") == "task_retrying", F.lit(False))
    failures = followed.filter("event = 'task_failed'")
    return failures.select(
        "id",
        "run_id",
        "task",
        F.coalesce(expected, F.lit(False)).alias("expected"),
        recorded.alias("recorded"),
    ).withColumn("agrees", F.col("expected") == F.col("recorded"))


def run_timeline(log: DataFrame) -> DataFrame:
    """Events in order of run and id, their details as a map of text."""
    detail = F.from_json("detail_json", "map<string,string>")
    return log.select("run_id", "id", "event", "task", "logged_at", detail.alias("detail")).orderBy(
        "run_id", "id"
    )


def approval_history(approvals: DataFrame) -> DataFrame:
    return approvals.orderBy("run_id", "iteration")


def approval_state(approvals: DataFrame) -> DataFrame:
    """The latest version of each run's briefing and what became of it."""
    pending = F.min(F.when(F.col("status") == "pending", F.col("id")))
    return approvals.groupBy("run_id").agg(
        F.max("iteration").alias("iteration"),
        F.max_by("status", "iteration").alias("latest_status"),
        F.max_by("id", "iteration").alias("latest_id"),
        pending.alias("pending_id"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def _revision_limit(configs: DataFrame) -> DataFrame:
    limit = F.get_json_object("config_json", "$.max_human_revisions").try_cast("bigint")
    return configs.select(
        "run_id", F.coalesce(limit, F.lit(DEFAULT_MAX_REVISIONS).cast("bigint")).alias("revision_limit")
    )


def transition_report(tasks: DataFrame, approvals: DataFrame, configs: DataFrame) -> DataFrame:
    """What each run is waiting for, from its committed rows."""
    done = F.bool_or((F.col("task_id") == "briefing_agent") & (F.col("status") == "succeeded"))
    runs = tasks.groupBy("run_id").agg(done.alias("briefed"))
    joined = runs.join(approval_state(approvals), "run_id", "left").join(
        _revision_limit(configs), "run_id", "left"
    )
    limit = F.coalesce("revision_limit", F.lit(DEFAULT_MAX_REVISIONS))
    latest = F.col("latest_status")
    action = (
        F.when(~F.col("briefed"), "none")
        .when(latest.isNull(), "request")
        .when(latest == "approved", "succeed")
        .when(latest == "pending", "wait")
        .when(F.col("rejected") >= limit, "fail_revision_limit")
        .otherwise("revise")
    )
    following = F.when(action == "request", 1).when(action == "revise", F.col("iteration") + 1)
    return joined.select(
        "run_id", action.alias("action"), following.cast("bigint").alias("next_iteration")
    )


def revision_limit(approvals: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs with as many rejected versions as their limit allows, or more."""
    state = approval_state(approvals).select("run_id", "rejected")
    joined = state.join(_revision_limit(configs), "run_id", "left")
    limit = F.coalesce("revision_limit", F.lit(DEFAULT_MAX_REVISIONS).cast("bigint"))
    return joined.filter(F.col("rejected") >= limit).select(
        "run_id", "rejected", limit.alias("revision_limit")
    )


def approval_integrity(approvals: DataFrame, versions: DataFrame) -> DataFrame:
    """Violations per invariant. ``versions`` holds logged ``(id, briefing_json)``."""
    status = F.col("status")
    pending = status == "pending"
    open_ok = pending & F.col("decision").isNull() & F.col("decided_at").isNull()
    closed_ok = (
        status.isin("approved", "rejected")
        & F.col("decision").eqNullSafe(status)
        & F.col("decided_at").isNotNull()
    )
    rows = approvals.agg(
        F.count_if(~(open_ok | closed_ok)).alias("decision_matches_status"),
        F.count_if(F.col("iteration") <= 0).alias("positive_iteration"),
    )
    per_run = approvals.groupBy("run_id").agg(F.count_if(pending).alias("n"))
    per_version = approvals.groupBy("run_id", "iteration").agg(F.count(F.lit(1)).alias("n"))
    texts = versions.groupBy("id").agg((F.min("briefing_json") != F.max("briefing_json")).alias("changed"))

    def result(df: DataFrame, check: str, count: Column) -> DataFrame:
        return df.agg(count.alias("violations")).select(F.lit(check).alias("check"), "violations")

    entries = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(name).alias("violations"))
            for name in ("decision_matches_status", "positive_iteration")
        ]
    )
    return (
        rows.select(F.explode(entries).alias("e"))
        .select("e.*")
        .unionByName(result(per_run, "one_pending_per_run", F.count_if(F.col("n") > 1)))
        .unionByName(result(per_version, "unique_version", F.count_if(F.col("n") > 1)))
        .unionByName(result(texts, "immutable_briefing", F.count_if("changed")))
    )


def decision_race(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """What became of each logged decision.

    ``decisions`` is ``(seq, approval_id, decision, comment)``; ``requests`` is
    ``(approval_id, run_id, iteration, requested_seq)``. Of the usable decisions
    on one version, the first counts; a version is closed to decisions once the
    next one was requested.
    """
    closing = neighbour(
        requests, ["run_id"], "iteration", {"closed_seq": "requested_seq"}, forward=True
    ).select("approval_id", "requested_seq", "closed_seq")
    # Requests have one row per approval; weigh them by their decisions.
    sizes = decisions.groupBy("approval_id").agg(F.count(F.lit(1)).alias("uses"))
    judged = join_per_key(decisions, closing.join(sizes, "approval_id"), ["approval_id"], "uses", "seq")
    explained = strip(F.coalesce("comment", F.lit(""))) != ""
    problem = (
        F.when((F.col("decision") == "rejected") & ~explained, "needs_comment")
        .when(F.col("requested_seq").isNull() | (F.col("seq") < F.col("requested_seq")), "not_requested")
        .when(F.col("seq") > F.col("closed_seq"), "superseded")
    )
    judged = judged.select("seq", "approval_id", "decision", "comment", problem.alias("problem"))
    first = judged.groupBy("approval_id").agg(
        F.min(F.when(F.col("problem").isNull(), F.col("seq"))).alias("first_seq"),
        F.count(F.lit(1)).alias("uses"),
    )
    joined = join_per_key(judged, first, ["approval_id"], "uses", "seq")
    outcome = F.coalesce(
        F.col("problem"),
        F.when(F.col("seq") == F.col("first_seq"), "effective").otherwise("already_decided"),
    )
    return joined.select("seq", "approval_id", "decision", outcome.alias("outcome"))


def run_stats(tasks: DataFrame) -> DataFrame:
    """Steps done, attempts, and the totals the two checks reported."""

    def reported(task: str, path: str) -> Column:
        output = F.when(
            (F.col("task_id") == task) & (F.col("status") == "succeeded"),
            F.get_json_object("output_json", path).try_cast("bigint"),
        )
        return F.max(output)

    return tasks.groupBy("run_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("steps_succeeded"),
        F.count(F.lit(1)).alias("steps"),
        F.sum("attempts").alias("attempts"),
        reported("quality_agent", "$.summary.issues").alias("issues"),
        reported("change_agent", "$.summary.total_changes").alias("changes"),
    )


def _fragment(fields: Column) -> Column:
    """The members of a JSON object, without its braces."""
    text = F.to_json(fields, {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _section(df: DataFrame, name: str, place: Column, body: Column) -> DataFrame:
    return df.select("run_id", F.lit(name).alias("section"), place.cast("bigint").alias("place"), body.alias("body"))


def _parsed(text: Column) -> Column:
    """Stored JSON, or NULL where it is none."""
    return F.try_parse_json(text)


def _run_sections(runs: DataFrame) -> DataFrame:
    address = F.coalesce(F.get_json_object("config_json", "$.llm_url"), F.lit(""))
    mode = F.when(address != "", "model").otherwise("local")
    head = F.struct("run_id", "status", "failure_reason", mode.alias("mode"))
    return _section(runs, "run", F.lit(0), _fragment(head))


def _task_sections(tasks: DataFrame) -> DataFrame:
    """The tasks in order of the plan, then any others; and the results of checks."""
    known = _plan_position(F.col("task_id"))
    entry = F.struct(F.col("task_id").alias("id"), "status", "attempts", "error")
    place = F.when(known > 0, known).otherwise(len(PLAN) + 1)
    listed = _section(tasks, "task", place, F.to_json(entry, {"ignoreNullFields": "false"}))
    result = _parsed(F.col("output_json"))
    ended = tasks.filter((F.col("status") == "succeeded") & F.col("task_id").isin(*RESULT_TASKS))
    outputs = ended.select("run_id", "task_id", known.alias("known"), result.alias("result")).filter("result is not null")
    body = F.concat(F.lit('"'), F.col("task_id"), F.lit('":'), F.to_json("result"))
    return listed.unionByName(_section(outputs, "result", F.col("known"), body))


def _approval_sections(approvals: DataFrame) -> DataFrame:
    """The first approvals of each run, the state of all of them, and the latest
    briefing, which stands for the result of its task."""
    order = Window.partitionBy("run_id").orderBy("iteration", "id")
    first = approvals.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MAX_LISTED_APPROVALS)
    briefing = _parsed(F.col("briefing_json")).alias("briefing")
    entry = F.struct("id", "iteration", "status", "decision", "comment", "decided_at", briefing)
    listed = _section(first, "approval", F.col("n"), F.to_json(entry, {"ignoreNullFields": "false"}))
    state = approvals.groupBy("run_id").agg(
        F.max("iteration").alias("approval_iteration"),
        F.min(F.when(F.col("status") == "pending", F.col("id"))).alias("active_approval_id"),
        F.count_if(F.col("status") == "rejected").alias("rejected_revisions"),
        F.count(F.lit(1)).alias("approval_count"),
        F.max_by("briefing_json", "iteration").alias("latest"),
    )
    numbers = F.struct("approval_iteration", "active_approval_id", "rejected_revisions", "approval_count")
    latest = state.select("run_id", _parsed(F.col("latest")).alias("latest")).filter("latest is not null")
    body = F.concat(F.lit('"briefing_agent":'), F.to_json("latest"))
    return (
        listed.unionByName(_section(state, "state", F.lit(0), _fragment(numbers)))
        .unionByName(_section(latest, "latest", F.lit(0), body))
    )


def _linked_section(df: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
    linked = df.select(F.col("workflow_run_id").alias("run_id"), *fields).filter("run_id is not null")
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return _section(linked, name, F.lit(0), body)


def run_document(
    runs: DataFrame, tasks: DataFrame, approvals: DataFrame, events: DataFrame, jobs: DataFrame
) -> DataFrame:
    """One JSON document per run: state, mode, plan, tasks, results, approvals, and
    the event and the job it came from.

    The sections of all runs are rows of one union and meet in one grouping. Each is
    bounded: a run has the tasks of the plan, one event and one job (the least by text
    if there are more), and its first ``MAX_LISTED_APPROVALS`` approvals are listed;
    ``approval_count`` tells how many there are, and the histories of approvals and
    events stay whole in ``approval_history`` and ``run_timeline``. The latest
    briefing stands for the result of its task. What is no JSON is left out.
    """
    parts = _run_sections(runs)
    for more in (
        _task_sections(tasks),
        _approval_sections(approvals),
        _linked_section(events, "ingestion", INGESTION_FIELDS),
        _linked_section(jobs, "queue", QUEUE_FIELDS),
    ):
        parts = parts.unionByName(more)

    def only(name: str) -> Column:
        return F.min(F.when(F.col("section") == name, F.col("body"))).alias(name)

    def listed(*names: str) -> Column:
        entry = F.when(F.col("section").isin(*names), F.struct("place", "body"))
        bodies = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["body"])
        return F.array_join(bodies, ",").alias(f"{names[0]}s")

    own_briefing = (F.col("section") == "result") & (F.col("place") == list(PLAN).index("briefing_agent") + 1)
    grouped = parts.withColumn("section", F.when(own_briefing, "briefing").otherwise(F.col("section"))).groupBy("run_id").agg(
        only("run"), only("state"), only("latest"), only("briefing"), only("ingestion"), only("queue"),
        listed("task"), listed("result"), listed("approval"),
    )
    none = '"approval_iteration":0,"active_approval_id":null,"rejected_revisions":0,"approval_count":0'
    results = F.concat_ws(",", F.nullif("results", F.lit("")), F.coalesce("latest", "briefing"))
    document = F.concat(
        F.lit("{"), F.col("run"), F.lit(f',"plan":{json.dumps(DOCUMENT_PLAN, separators=(",", ":"))},"tasks":['),
        F.col("tasks"), F.lit('],"results":{'), results, F.lit('},"approvals":['), F.col("approvals"), F.lit("],"),
        F.coalesce("state", F.lit(none)), F.lit(',"ingestion":'), F.coalesce("ingestion", F.lit("null")),
        F.lit(',"queue":'), F.coalesce("queue", F.lit("null")), F.lit("}"),
    )
    return grouped.filter("run is not null").select("run_id", document.alias("document"))
