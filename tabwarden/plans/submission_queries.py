"""Submission ingestion (ING) over receipts derived from ``events`` and event
tables derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import submissions as s
from tabwarden.plans.registry import query

# What the document of each derived receipt is worth, read off its shape.
DECODE = """CASE WHEN shape = 'error' AND (k < 10 OR k BETWEEN 20 AND 49) THEN 'invalid_json'
  WHEN shape = 'error' AND k < 20 THEN 'not_an_object' END"""
FIELD = f"""coalesce({DECODE}, CASE WHEN shape = 'error' THEN CASE WHEN k < 55 THEN 'missing:input'
  WHEN k < 60 THEN 'unknown:module' WHEN k < 70 THEN 'not_text:input' WHEN k < 75 THEN 'not_text:key'
  WHEN k < 80 THEN 'event_type' WHEN k < 85 THEN 'key' WHEN k < 90 THEN 'event_id'
  ELSE 'not_text:event_id' END END)"""
ROLE_ROWS = f"""SELECT receipt_seq, 0 AS role_idx, 'input' AS role,
  CASE WHEN shape = 'click' AND k BETWEEN 20 AND 59 THEN 'absolute:input'
    WHEN shape = 'click' AND k < 20 THEN 'escapes:input' END AS error,
  CASE WHEN shape = 'click' AND k >= 80 THEN concat('inbox/', file, '.absent')
    ELSE concat('inbox/', file) END AS source_path FROM receipt_parts WHERE {FIELD} IS NULL
UNION ALL SELECT receipt_seq, 1, 'rules', NULL, concat('inbox/data/', CAST(k // 10 AS VARCHAR), '.csv')
FROM receipt_parts WHERE {FIELD} IS NULL
UNION ALL SELECT receipt_seq, 2, 'before', NULL, 'inbox/data/1.csv' FROM receipt_parts WHERE {FIELD} IS NULL
UNION ALL SELECT receipt_seq, 3, 'after', NULL, 'inbox/data/2.csv' FROM receipt_parts WHERE {FIELD} IS NULL"""
PRESENT = f"""SELECT r.receipt_seq, r.role_idx, r.role, sha256, CASE WHEN r.error IS NOT NULL THEN r.error
  WHEN sha256 IS NULL THEN concat('absent:', r.role)
  WHEN length > 10485760 THEN concat('too_large:', r.role) END AS error
FROM ({ROLE_ROWS}) AS r LEFT JOIN source_files AS f ON r.error IS NULL AND f.path = r.source_path"""
HASHED = f"""SELECT receipt_seq, arg_min(error, role_idx) FILTER (error IS NOT NULL) AS source_error,
  max(sha256) FILTER (role = 'input') AS i, max(sha256) FILTER (role = 'rules') AS r,
  max(sha256) FILTER (role = 'before') AS b, max(sha256) FILTER (role = 'after') AS a
FROM ({PRESENT}) AS present GROUP BY receipt_seq"""
VALID = f"""SELECT p.receipt_seq, p.scan_id, p.path, p.k, p.shape, d.raw_hash,
  coalesce({FIELD}, h.source_error) AS error,
  CASE WHEN shape = 'signup' THEN concat('user-', CAST(user_id AS VARCHAR))
    WHEN shape = 'purchase' THEN concat('buy-', CAST(k AS VARCHAR))
    WHEN shape = 'error' AND k BETWEEN 85 AND 89 THEN repeat('a', 257) END AS external_id,
  CASE WHEN {FIELD} IS NULL AND h.source_error IS NULL THEN sha256(concat('{{"event_type":"orders_check","key":"',
    CASE WHEN shape = 'purchase' THEN 'alt' ELSE 'order_id' END, '","source_hashes":{{"after":"', h.a,
    '","before":"', h.b, '","input":"', h.i, '","rules":"', h.r, '"}},"version":1}}')) END AS fingerprint
FROM receipt_parts AS p JOIN receipts AS d ON d.receipt_seq = p.receipt_seq
LEFT JOIN ({HASHED}) AS h ON h.receipt_seq = p.receipt_seq""".replace("{{", "{").replace("}}", "}")
RESOLVED = f"""SELECT v.* EXCLUDE (error), CASE WHEN v.error IS NULL AND v.fingerprint <> b.fingerprint
  THEN 'external_id_conflict' ELSE v.error END AS error
FROM ({VALID}) AS v LEFT JOIN (SELECT external_id, arg_min(fingerprint, receipt_seq) AS fingerprint
  FROM ({VALID}) AS named WHERE error IS NULL AND external_id IS NOT NULL GROUP BY external_id) AS b
ON b.external_id = v.external_id"""
EVENTS = f"""SELECT fingerprint, min(receipt_seq) AS first_seq, arg_min(path, receipt_seq) AS path,
  coalesce(first(external_id ORDER BY receipt_seq), '') AS external_id, count(*) - 1 AS duplicates
FROM ({RESOLVED}) AS resolved WHERE error IS NULL GROUP BY fingerprint"""
RUNS = f"""SELECT left(sha256(fingerprint), 32) AS run_id, CASE WHEN first_seq % 3 = 0 THEN 'FAILED'
  ELSE 'SUCCEEDED' END AS status FROM ({EVENTS}) AS events_found WHERE duplicates > 0"""


def _receipts(t):
    return t["receipts"], t["source_files"]


def _resolved(t):
    return s.resolved_receipts(*_receipts(t))


def _runs(events):
    status = F.when(F.col("first_seq") % 3 == 0, "FAILED").otherwise("SUCCEEDED")
    return s.run_reservation(events).filter("duplicates > 0").select("run_id", status.alias("status"))


@query("ing_01_manifest_decode", f"SELECT receipt_seq, coalesce({DECODE}, '') AS error FROM receipt_parts")
def _(t):
    decoded = s.manifest_decode(t["receipts"])
    return decoded.select("receipt_seq", F.coalesce("error", F.lit("")).alias("error"))


@query(
    "ing_02_manifest_fields",
    f"""SELECT receipt_seq, coalesce({FIELD}, '') AS error,
  CASE WHEN {FIELD} IS NULL THEN CASE WHEN shape = 'purchase' THEN 'alt' ELSE 'order_id' END ELSE '' END AS key
FROM receipt_parts""",
)
def _(t):
    checked = s.manifest_fields(s.manifest_decode(t["receipts"]))
    key = F.when(F.col("error").isNull(), F.col("key")).otherwise("")
    return checked.select("receipt_seq", F.coalesce("error", F.lit("")).alias("error"), key.alias("key"))


@query(
    "ing_03_path_containment",
    f"""SELECT receipt_seq, role, coalesce(error, '') AS error,
  CASE WHEN error IS NULL THEN source_path ELSE '' END AS source_path FROM ({ROLE_ROWS}) AS roles""",
)
def _(t):
    checked = s.manifest_fields(s.manifest_decode(t["receipts"]))
    blank = F.lit("")
    return s.path_containment(checked).select(
        "receipt_seq",
        "role",
        F.coalesce("error", blank).alias("error"),
        F.coalesce("source_path", blank).alias("source_path"),
    )


@query(
    "ing_04_source_presence",
    f"SELECT receipt_seq, role, coalesce(error, '') AS error, sha256 FROM ({PRESENT}) AS present",
)
def _(t):
    receipts, files = _receipts(t)
    roles = s.path_containment(s.checked_receipts(receipts))
    return s.source_presence(roles, files).select(
        "receipt_seq", "role", F.coalesce("error", F.lit("")).alias("error"), "sha256"
    )


@query(
    "ing_05_canonical_fingerprint",
    f"SELECT receipt_seq, coalesce(error, '') AS error, fingerprint FROM ({VALID}) AS valid",
)
def _(t):
    valid = s.validated(*_receipts(t))
    return valid.select("receipt_seq", F.coalesce("error", F.lit("")).alias("error"), "fingerprint")


@query(
    "ing_06_execution_fingerprint",
    f"""SELECT count(fingerprint) AS receipts, count(DISTINCT concat(fingerprint, ' ', CAST(k AS VARCHAR)))
  FILTER (error IS NULL) AS executions, count(DISTINCT fingerprint) AS contents FROM ({VALID}) AS valid""",
)
def _(t):
    """Executions tell paths apart where contents do not."""
    valid = s.validated(*_receipts(t))
    return valid.agg(
        F.count("fingerprint").alias("receipts"),
        F.countDistinct("execution_fingerprint").alias("executions"),
        F.countDistinct("fingerprint").alias("contents"),
    )


@query("ing_07_canonical_events", EVENTS)
def _(t):
    events = s.canonical_events(_resolved(t))
    external = F.coalesce("external_id", F.lit("")).alias("external_id")
    return events.select("fingerprint", "first_seq", "path", external, "duplicates")


@query("ing_08_duplicate_count", f"SELECT fingerprint, duplicates FROM ({EVENTS}) AS events_found")
def _(t):
    return s.duplicate_count(_resolved(t))


@query(
    "ing_09_external_id_conflict",
    f"SELECT receipt_seq, external_id, fingerprint FROM ({RESOLVED}) AS r WHERE error = 'external_id_conflict'",
)
def _(t):
    valid = s.validated(*_receipts(t))
    conflicts = s.external_id_conflict(valid).filter("error = 'external_id_conflict'")
    return conflicts.select("receipt_seq", "external_id", "fingerprint")


@query(
    "ing_10_external_aliases",
    f"""SELECT DISTINCT fingerprint, external_id FROM ({RESOLVED}) AS r
WHERE error IS NULL AND external_id IS NOT NULL""",
)
def _(t):
    return s.external_aliases(_resolved(t))


@query(
    "ing_11_invalid_events",
    f"""SELECT path, error, min(receipt_seq) AS first_seq, coalesce(first(external_id ORDER BY receipt_seq), '')
  AS external_id, count(*) - 1 AS repeats FROM ({RESOLVED}) AS r WHERE error IS NOT NULL
GROUP BY path, raw_hash, error, fingerprint""",
)
def _(t):
    external = F.coalesce("external_id", F.lit("")).alias("external_id")
    return s.invalid_events(_resolved(t)).select("path", "error", "first_seq", external, "repeats")


@query(
    "ing_12_scan_summary",
    f"""SELECT r.scan_id, count(*) AS scanned, count(*) FILTER (r.error IS NULL AND r.receipt_seq = e.first_seq) AS new_events,
  count(*) FILTER (r.error IS NULL AND r.receipt_seq <> e.first_seq) AS duplicates,
  count(*) FILTER (r.error IS NOT NULL) AS invalid,
  count(*) FILTER (r.error IS NULL AND u.status = 'FAILED') AS failed,
  count(*) FILTER (r.error IS NULL AND r.receipt_seq = e.first_seq AND u.run_id IS NOT NULL) AS workflows_created
FROM ({RESOLVED}) AS r LEFT JOIN ({EVENTS}) AS e ON e.fingerprint = r.fingerprint
LEFT JOIN ({RUNS}) AS u ON u.run_id = left(sha256(e.fingerprint), 32) GROUP BY r.scan_id""",
)
def _(t):
    resolved = _resolved(t)
    events = s.canonical_events(resolved)
    return s.scan_summary(resolved, events, _runs(events))


STATUS = """SELECT e.id, CASE WHEN r.run_id IS NULL OR (e.status = 'FAILED' AND r.status IN ('PENDING', 'RUNNING'))
    THEN e.status WHEN r.status = 'WAITING_FOR_APPROVAL' THEN r.status WHEN r.status = 'SUCCEEDED' THEN 'COMPLETED'
    WHEN r.status = 'FAILED' THEN 'FAILED' ELSE 'WORKFLOW_CREATED' END AS status,
  CASE WHEN r.run_id IS NULL OR (e.status = 'FAILED' AND r.status IN ('PENDING', 'RUNNING')) THEN e.error
    WHEN r.status = 'FAILED' THEN r.failure_reason END AS error, l.run_id IS NOT NULL AS limited
FROM event_rows AS e LEFT JOIN run_rows AS r ON r.run_id = e.workflow_run_id
LEFT JOIN (SELECT DISTINCT run_id FROM run_limits WHERE event = 'revision_limit_reached') AS l
  ON l.run_id = e.workflow_run_id"""
STATUS = f"SELECT id, status, error, status = 'FAILED' AND NOT limited AS retryable FROM ({STATUS}) AS linked"


@query("ing_13_event_status", STATUS)
def _(t):
    return s.event_status(t["event_rows"], t["run_rows"], t["run_limits"])


@query(
    "ing_14_event_transitions",
    """SELECT id, ingestion_id, status, error FROM (SELECT *,
  lag(status) OVER (PARTITION BY ingestion_id ORDER BY id) AS p_status,
  lag(error) OVER (PARTITION BY ingestion_id ORDER BY id) AS p_error FROM event_log) AS seen
WHERE status IS DISTINCT FROM p_status OR error IS DISTINCT FROM p_error""",
)
def _(t):
    return s.event_transitions(t["event_log"]).select("id", "ingestion_id", "status", "error")


@query(
    "ing_15_event_history",
    """SELECT ingestion_id, id, logged_at, status, error FROM event_log
WHERE ingestion_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
)
def _(t):
    events = t["customer"].select(F.col("c_custkey").cast("string").alias("id"))
    return s.event_history(events, t["event_log"])


@query("ing_16_event_listing", "SELECT id, status, received_at FROM event_rows")
def _(t):
    return s.event_listing(t["event_rows"]).select("id", "status", "received_at")


@query(
    "ing_17_run_linkage",
    """SELECT r.run_id, e.id AS ingestion_id, e.event_id, e.manifest_path, e.fingerprint, e.status AS event_status
FROM run_rows AS r JOIN event_rows AS e ON e.workflow_run_id = r.run_id""",
)
def _(t):
    return s.run_linkage(t["event_rows"], t["run_rows"])


@query(
    "ing_18_retry_eligible",
    f"""SELECT id, status FROM ({STATUS}) AS states
WHERE status NOT IN ('INVALID', 'WAITING_FOR_APPROVAL', 'COMPLETED') AND (status <> 'FAILED' OR retryable)""",
)
def _(t):
    states = s.event_status(t["event_rows"], t["run_rows"], t["run_limits"])
    return s.retry_eligible(states).select("id", "status")


@query(
    "ing_19_run_reservation",
    f"SELECT fingerprint, first_seq, left(sha256(fingerprint), 32) AS run_id FROM ({EVENTS}) AS events_found",
)
def _(t):
    events = s.canonical_events(_resolved(t))
    return s.run_reservation(events).select("fingerprint", "first_seq", "run_id")


@query(
    "ing_20_event_integrity",
    """SELECT 'one_event_per_content' AS "check", count(*) AS violations FROM (SELECT fingerprint FROM event_rows
  WHERE status <> 'INVALID' GROUP BY fingerprint HAVING count(*) > 1) AS a
UNION ALL SELECT 'unique_identity', count(*) FROM (SELECT identity_key FROM event_rows GROUP BY 1 HAVING count(*) > 1) AS b
UNION ALL SELECT 'unique_run', count(*) FROM (SELECT workflow_run_id FROM event_rows
  WHERE workflow_run_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) AS c
UNION ALL SELECT 'invalid_without_run', count(*) FROM event_rows WHERE status = 'INVALID' AND workflow_run_id IS NOT NULL
UNION ALL SELECT 'immutable_identity', count(*) FROM (SELECT event_id FROM event_rows GROUP BY event_id
  HAVING count(DISTINCT fingerprint) > 1 OR count(DISTINCT workflow_run_id) > 1) AS d""",
)
def _(t):
    """Events sharing an external id serve as logged versions of one event."""
    events = t["event_rows"]
    versions = events.select(F.col("event_id").alias("id"), "fingerprint", "workflow_run_id")
    return s.event_integrity(events, versions)
