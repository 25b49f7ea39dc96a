"""Submitted jobs: decoding, checking, and idempotent deduplication by content.

The input is an append-only log of receipts, ``(receipt_seq, scan_id, path,
raw_hash, doc)``; everything else is derived from it. ``listing`` names the files
there are, ``(path, length, sha256)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.hotkeys import join_per_key, neighbour
from tabwarden.functions.staging import evaluated
from tabwarden.functions.text import strip
from tabwarden.session import written
from tabwarden.sources.inbox import MAX_DOCUMENT_BYTES, MAX_SOURCE_BYTES
from tabwarden.sources.rule_docs import json_kind, strict_json, without_mark

# The fields of a submission.
ROLES = ("input", "rules", "before", "after")
REQUIRED_FIELDS = ("after", "before", "event_type", "input", "rules")
OPTIONAL_FIELDS = ("event_id", "key")
EVENT_TYPE = "orders_check"
DEFAULT_KEY = "order_id"
MAX_NAME_LENGTH = 256

# Event states, and those a linked run's state maps to.
RUN_TO_EVENT = {
    "WAITING_FOR_APPROVAL": "WAITING_FOR_APPROVAL",
    "SUCCEEDED": "COMPLETED",
    "FAILED": "FAILED",
}


def manifest_decode(receipts: DataFrame) -> DataFrame:
    """Add ``keys`` (in document order), ``texts`` (NULL where a value is not
    text) and ``error`` for documents that are not one strict JSON object."""
    value = strict_json(F.col("doc"))
    parsed = evaluated(receipts, *receipts.columns, value.alias("__v"))
    # Only an object is a map of its members.
    members = F.try_variant_get("__v", "$", "map<string,variant>")
    read = evaluated(parsed, *receipts.columns, members.alias("__members"), F.col("__v").isNull().alias("__broken"))
    texts = F.transform_values(
        "__members",
        lambda _, value: F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")),
    )
    is_object = F.col("__members").isNotNull()
    error = (
        F.when(F.octet_length("doc") > MAX_DOCUMENT_BYTES, "too_large")
        .when(~F.is_valid_utf8("doc"), "not_utf8")
        .when(F.col("__broken"), "invalid_json")
        .when(~is_object, "not_an_object")
    )
    return evaluated(
        read,
        *receipts.columns,
        F.when(is_object, F.json_object_keys(without_mark(F.col("doc")))).alias("keys"),
        texts.alias("texts"),
        error.alias("error"),
    )


def _first(codes: list[Column]) -> Column:
    return F.coalesce(*codes)


def manifest_fields(decoded: DataFrame, event_type: str = EVENT_TYPE) -> DataFrame:
    """Check names and values; ``error`` is the first problem in fixed order.

    Adds ``key`` (stripped, defaulted) and ``external_id``.
    """

    def text(name: str) -> Column:
        return F.col("texts")[F.lit(name)]

    missing = [
        F.when(~F.array_contains("keys", name), F.lit(f"missing:{name}"))
        for name in REQUIRED_FIELDS
    ]
    known = F.array(*[F.lit(name) for name in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)])
    unknown = F.array_min(F.array_except("keys", known))

    def unusable(name: Column) -> Column:
        value = F.col("texts")[name]
        return (F.coalesce(strip(value), F.lit("")) == "") | value.contains("\0")

    not_text = F.get(F.filter("keys", unusable), F.lit(0))
    key = strip(F.coalesce(text("key"), F.lit(DEFAULT_KEY)))
    external = text("event_id")

    def bad_name(value: Column) -> Column:
        return (F.length(value) > MAX_NAME_LENGTH) | value.rlike(r"[\x00-\x1f]")

    problem = _first(
        [
            F.col("error"),
            *missing,
            F.when(unknown.isNotNull(), F.concat(F.lit("unknown:"), unknown)),
            F.when(not_text.isNotNull(), F.concat(F.lit("not_text:"), not_text)),
            F.when(text("event_type") != event_type, F.lit("event_type")),
            F.when(bad_name(key), F.lit("key")),
            F.when(bad_name(external), F.lit("event_id")),
        ]
    )
    return evaluated(
        decoded,
        *[name for name in decoded.columns if name != "error"],
        problem.alias("error"),
        F.when(F.col("keys").isNotNull(), key).alias("key"),
        external.alias("external_id"),
    )


def checked_receipts(receipts: DataFrame) -> DataFrame:
    """``manifest_fields`` of every receipt, written once, as later steps read it several
    times. Reading a document costs far more than moving it, and a large file may be few
    splits, so receipts are dealt over all tasks first."""
    dealt = receipts.repartition("receipt_seq")
    return written(manifest_fields(manifest_decode(dealt)), "checked-receipts")


def _resolved(path: Column) -> Column:
    """A path after taking out its components ``.``, ``..`` and empty ones, if any."""
    whole = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, part)),
    )
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|\z)"), F.concat_ws("/", whole)).otherwise(path)


def path_containment(checked: DataFrame) -> DataFrame:
    """One row per receipt and role of the receipts without error so far:
    ``(receipt_seq, role_idx, role, source_path, error)``."""
    roles = F.array(
        *[
            F.struct(
                F.lit(place).alias("role_idx"),
                F.lit(role).alias("role"),
                F.replace(F.col("texts")[F.lit(role)], F.lit("\\"), F.lit("/")).alias("value"),
            )
            for place, role in enumerate(ROLES)
        ]
    )
    usable = checked.filter(F.col("error").isNull())
    directory = F.regexp_extract("path", r"^(.*?)/?[^/]*\z", 1)
    # Once per receipt: where it lies, and its roles.
    placed = evaluated(usable, "receipt_seq", directory.alias("directory"), _resolved(directory).alias("home"), roles.alias("roles"))
    rows = placed.select("receipt_seq", "directory", "home", F.explode("roles").alias("r")).select(
        "receipt_seq", "directory", "home", "r.*"
    )
    resolved = evaluated(
        rows,
        "receipt_seq",
        "role_idx",
        "role",
        "value",
        "home",
        _resolved(F.concat("directory", F.lit("/"), "value")).alias("inside"),
    )
    inside, home = F.col("inside"), F.col("home")
    absolute = F.col("value").startswith("/") | F.col("value").contains(":")
    contained = (home == "") | (inside == home) | inside.startswith(F.concat(home, F.lit("/")))
    error = F.when(absolute, F.concat(F.lit("absolute:"), F.col("role"))).when(
        ~contained, F.concat(F.lit("escapes:"), F.col("role"))
    )
    return evaluated(
        resolved,
        "receipt_seq",
        "role_idx",
        "role",
        F.when(error.isNull(), inside).alias("source_path"),
        error.alias("error"),
    )


def source_presence(roles: DataFrame, listing: DataFrame) -> DataFrame:
    """Add the hash of each role's file, or the problem with it.

    Any number of receipts may name the same file, so files are joined as per-key
    rows with their number of uses.
    """
    uses = roles.filter(F.col("source_path").isNotNull()).groupBy("source_path").agg(
        F.count(F.lit(1)).alias("uses")
    )
    files = listing.select(F.col("path").alias("source_path"), "length", "sha256")
    known = uses.join(files, "source_path")
    joined = join_per_key(roles, known, ["source_path"], "uses", "receipt_seq")
    role = F.col("role")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("sha256").isNull(), F.concat(F.lit("absent:"), role))
        .when(F.col("length") > MAX_SOURCE_BYTES, F.concat(F.lit("too_large:"), role))
    )
    return joined.select(
        "receipt_seq", "role_idx", "role", "source_path", "sha256", error.alias("error")
    )


def canonical_fingerprint(key: Column, hashes: dict[str, Column]) -> Column:
    """Identity of a job: its settings and the content of its sources by role.

    Names, places, external ids and the spelling of the document do not count.
    """
    sources = F.struct(*[hashes[role].alias(role) for role in sorted(hashes)])
    identity = F.struct(
        F.lit(EVENT_TYPE).alias("event_type"),
        key.alias("key"),
        sources.alias("source_hashes"),
        F.lit(1).alias("version"),
    )
    return F.sha2(F.to_json(identity), 256)


def execution_fingerprint(key: Column, paths: list[Column], hashes: list[Column]) -> Column:
    """Identity of one execution: settings with the path and content of each source."""
    inputs = F.array(
        *[
            F.struct(path.alias("path"), digest.alias("sha256"))
            for path, digest in zip(paths, hashes, strict=True)
        ]
    )
    config = F.struct(F.array(*paths).alias("input_paths"), key.alias("key"))
    return F.sha2(F.to_json(F.struct(config.alias("config"), inputs.alias("inputs"))), 256)


def validated(receipts: DataFrame, listing: DataFrame) -> DataFrame:
    """Every receipt with its first problem, or its fingerprints if sound."""
    checked = checked_receipts(receipts)
    roles = source_presence(path_containment(checked), listing)
    first_problem = F.min_by(
        "error", F.when(F.col("error").isNotNull(), F.col("role_idx"))
    )
    per_receipt = roles.groupBy("receipt_seq").agg(
        first_problem.alias("source_error"),
        *[F.max(F.when(F.col("role") == r, F.col("sha256"))).alias(f"{r}_hash") for r in ROLES],
        *[F.max(F.when(F.col("role") == r, F.col("source_path"))).alias(f"{r}_path") for r in ROLES],
    )
    joined = checked.join(per_receipt, "receipt_seq", "left")
    error = F.coalesce("error", "source_error")
    sound = error.isNull()
    hashes = {role: F.col(f"{role}_hash") for role in ROLES}
    paths = [F.col(f"{role}_path") for role in ROLES]
    return joined.select(
        "receipt_seq",
        "scan_id",
        "path",
        "raw_hash",
        "external_id",
        error.alias("error"),
        F.when(sound, canonical_fingerprint(F.col("key"), hashes)).alias("fingerprint"),
        F.when(sound, execution_fingerprint(F.col("key"), paths, list(hashes.values()))).alias(
            "execution_fingerprint"
        ),
    )


def external_bindings(valid: DataFrame) -> DataFrame:
    """Each external id with the fingerprint of its first valid receipt."""
    named = valid.filter(F.col("error").isNull() & F.col("external_id").isNotNull())
    return named.groupBy("external_id").agg(
        F.min_by("fingerprint", "receipt_seq").alias("bound_fingerprint"),
        F.min("receipt_seq").alias("bound_seq"),
        F.count(F.lit(1)).alias("uses"),
    )


def external_id_conflict(valid: DataFrame) -> DataFrame:
    """Receipts, with ``error`` set where an external id is bound to other content.

    A bad receipt never binds; a conflicting one never rebinds.
    """
    bindings = external_bindings(valid).drop("bound_seq")
    joined = join_per_key(valid, bindings, ["external_id"], "uses", "receipt_seq")
    clash = F.col("error").isNull() & (F.col("fingerprint") != F.col("bound_fingerprint"))
    error = F.when(clash, F.lit("external_id_conflict")).otherwise(F.col("error"))
    return joined.select(
        *[name for name in valid.columns if name != "error"], error.alias("error")
    )


def resolved_receipts(receipts: DataFrame, listing: DataFrame) -> DataFrame:
    """Receipts with their final error; written once, as several results follow."""
    valid = written(validated(receipts, listing), "receipts")
    return written(external_id_conflict(valid), "resolved-receipts")


def canonical_events(resolved: DataFrame) -> DataFrame:
    """One event per content, from its earliest accepted receipt, with the number
    of later ones."""
    accepted = resolved.filter(F.col("error").isNull())
    first = F.struct("receipt_seq", "path", "external_id", "scan_id", "execution_fingerprint")
    events = accepted.groupBy("fingerprint").agg(
        F.min_by(first, "receipt_seq").alias("first"), (F.count(F.lit(1)) - 1).alias("duplicates")
    )
    return events.select(
        "fingerprint",
        F.col("first.receipt_seq").alias("first_seq"),
        F.col("first.path").alias("path"),
        F.col("first.external_id").alias("external_id"),
        F.col("first.scan_id").alias("scan_id"),
        F.col("first.execution_fingerprint").alias("execution_fingerprint"),
        "duplicates",
    )


def duplicate_count(resolved: DataFrame) -> DataFrame:
    accepted = resolved.filter(F.col("error").isNull())
    return accepted.groupBy("fingerprint").agg((F.count(F.lit(1)) - 1).alias("duplicates"))


def external_aliases(resolved: DataFrame) -> DataFrame:
    """External ids per event, one row each: an event may have any number."""
    named = resolved.filter(F.col("error").isNull() & F.col("external_id").isNotNull())
    return named.select("fingerprint", "external_id").distinct()


def invalid_events(resolved: DataFrame) -> DataFrame:
    """Bad receipts, repeats of the same one collapsed into a count."""
    bad = resolved.filter(F.col("error").isNotNull())
    identity = F.sha2(
        F.to_json(F.array("path", "raw_hash", F.col("error"), F.coalesce("fingerprint", F.lit("")))), 256
    )
    first = F.struct("receipt_seq", "path", "error", "external_id")
    grouped = bad.withColumn("identity", identity).groupBy("identity").agg(
        F.min_by(first, "receipt_seq").alias("first"), (F.count(F.lit(1)) - 1).alias("repeats")
    )
    return grouped.select(
        "identity",
        F.col("first.receipt_seq").alias("first_seq"),
        F.col("first.path").alias("path"),
        F.col("first.error").alias("error"),
        F.col("first.external_id").alias("external_id"),
        "repeats",
    )


def run_id(fingerprint: Column) -> Column:
    """The run reserved for an event: a function of its content, so immutable."""
    return F.left(F.sha2(fingerprint, 256), F.lit(32))


def run_reservation(events: DataFrame) -> DataFrame:
    return events.select("*", run_id(F.col("fingerprint")).alias("run_id"))


def scan_summary(resolved: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """Totals per scan. Receipts are counted per scan and content before they meet
    the events, so popular content joins as few rows."""
    bad = F.col("error").isNotNull()
    groups = resolved.groupBy("scan_id", "fingerprint", bad.alias("bad")).agg(
        F.count(F.lit(1)).alias("n"), F.min("receipt_seq").alias("earliest")
    )
    states = run_reservation(events).join(
        runs.select("run_id", F.col("status").alias("run_status")), "run_id", "left"
    )
    states = states.select("fingerprint", "first_seq", "run_status")
    # Bad receipts may share content with an event; they stay bad.
    joined = groups.join(states, "fingerprint", "left")
    good = ~F.col("bad")
    fresh = F.when(good & (F.col("earliest") == F.col("first_seq")), 1).otherwise(0)
    has_run = F.col("run_status").isNotNull()
    failed = good & (F.col("run_status") == "FAILED")

    def total(value: Column) -> Column:
        return F.sum(value).cast("bigint")

    return joined.groupBy("scan_id").agg(
        total(F.col("n")).alias("scanned"),
        total(fresh).alias("new_events"),
        total(F.when(good, F.col("n") - fresh).otherwise(0)).alias("duplicates"),
        total(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("invalid"),
        total(F.when(failed, F.col("n")).otherwise(0)).alias("failed"),
        total(F.when(has_run, fresh).otherwise(0)).alias("workflows_created"),
    )


# --- event tables --------------------------------------------------------------


def limited_runs(run_events: DataFrame) -> DataFrame:
    """Runs that logged the revision limit."""
    hit = run_events.filter(F.col("event") == "revision_limit_reached")
    return hit.select("run_id").distinct().withColumn("limited", F.lit(True))


def event_status(events: DataFrame, runs: DataFrame, run_events: DataFrame) -> DataFrame:
    """State of each event as its run implies it.

    An ingestion failure over a run that has not ended is kept.
    """
    linked = (
        events.join(
            runs.select(
                F.col("run_id").alias("workflow_run_id"),
                F.col("status").alias("run_status"),
                "failure_reason",
            ),
            "workflow_run_id",
            "left",
        )
        .join(
            limited_runs(run_events).withColumnRenamed("run_id", "workflow_run_id"),
            "workflow_run_id",
            "left",
        )
    )
    run_status = F.col("run_status")
    implied = F.lit("WORKFLOW_CREATED")
    for run_state, event_state in RUN_TO_EVENT.items():
        implied = F.when(run_status == run_state, event_state).otherwise(implied)
    kept = (F.col("status") == "FAILED") & run_status.isin("PENDING", "RUNNING")
    status = F.when(run_status.isNull() | kept, F.col("status")).otherwise(implied)
    error = (
        F.when(run_status.isNull() | kept, F.col("error"))
        .when(run_status == "FAILED", F.col("failure_reason"))
    )
    retryable = (status == "FAILED") & F.col("limited").isNull()
    return linked.select("id", status.alias("status"), error.alias("error"), retryable.alias("retryable"))


def event_transitions(log: DataFrame) -> DataFrame:
    """Log rows at which the status or the error of an event changed."""
    seen = neighbour(
        log, ["ingestion_id"], "id", {"previous_status": "status", "previous_error": "error"}
    )
    same = F.col("status").eqNullSafe(F.col("previous_status")) & F.col("error").eqNullSafe(
        F.col("previous_error")
    )
    return seen.filter(~same)


def event_history(events: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows of known events in order of event and log id.

    Long form, range-sorted on both columns: an event with a very long history is
    spread over many tasks.
    """
    known = events.select(F.col("id").alias("ingestion_id"))
    return log.join(known, "ingestion_id", "left_semi").orderBy("ingestion_id", "id")


def event_listing(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("received_at"), "id")


def run_linkage(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Event details of each run that has one."""
    details = events.select(
        F.col("workflow_run_id").alias("run_id"),
        F.col("id").alias("ingestion_id"),
        "event_id",
        "manifest_path",
        "fingerprint",
        F.col("status").alias("event_status"),
    )
    return runs.select("run_id").join(details, "run_id")


def retry_eligible(states: DataFrame) -> DataFrame:
    ended = F.col("status").isin("INVALID", "WAITING_FOR_APPROVAL", "COMPLETED")
    blocked = (F.col("status") == "FAILED") & ~F.col("retryable")
    return states.filter(~ended & ~blocked)


def event_integrity(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Violations per invariant of the event tables.

    ``versions`` holds logged states of events, ``(id, fingerprint, workflow_run_id)``.
    """
    valid = events.filter("status <> 'INVALID'")

    def repeated(df: DataFrame, column: str, check: str) -> DataFrame:
        groups = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
            F.lit(check).alias("check"), "violations"
        )

    # Minimum and maximum tell whether a value ever changed, without a set of all
    # values; a NULL run may be filled once.
    spans = versions.groupBy("id").agg(
        (F.min("fingerprint") != F.max("fingerprint")).alias("content"),
        (F.min("workflow_run_id") != F.max("workflow_run_id")).alias("run"),
    )
    changed = spans.agg(F.count_if(F.col("content") | F.col("run")).alias("violations"))
    reserved = events.filter("status = 'INVALID' AND workflow_run_id IS NOT NULL")
    parts = [
        repeated(valid, "fingerprint", "one_event_per_content"),
        repeated(events, "identity_key", "unique_identity"),
        repeated(events, "workflow_run_id", "unique_run"),
        reserved.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit("invalid_without_run").alias("check"), "violations"
        ),
        changed.select(F.lit("immutable_identity").alias("check"), "violations"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
