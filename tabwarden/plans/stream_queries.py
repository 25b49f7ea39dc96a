"""Streaming forms (STR): inputs arrive as files in sequence, the streams run until
they are drained, and the drained tables are returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwarden.functions.hotkeys import Running, running
from tabwarden.operators import delivery, submissions
from tabwarden.operators.validation import FINDING_COLUMNS
from tabwarden.plans.check_queries import ALLOWED, DATE, EMAIL, MAX, MAX_REGION, INTEGER, MIN, NUMBER
from tabwarden.plans.check_queries import ACCOUNT_RULES, REQUIRED_EMAIL, REQUIRED_ID
from tabwarden.plans.diff_queries import SUMMARY
from tabwarden.plans.delivery_queries import LEASE_SECONDS
from tabwarden.plans.registry import query
from tabwarden.plans.submission_queries import EVENTS
from tabwarden.session import scratch_path, written
from tabwarden.sources.sinks import write_documents
from tabwarden.streaming import leases
from tabwarden.streaming import streams as st

_PARTS = 3
MAX_ATTEMPTS = 3


def _arriving(t, df: DataFrame, order: str, label: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """``df``, all rows, as a stream of parts that arrive in order of ``order``. ``start``
    is called with the stream after each arrival, and goes on from its checkpoint."""
    path, rows = scratch_path(t.spark, label), written(df, f"{label}-rows")
    bounds = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, width = bounds.low or 0, ((bounds.high or 0) - (bounds.low or 0)) // _PARTS + 1
    for part in range(_PARTS):
        here = low + part * width
        rows.filter((F.col(order) >= here) & (F.col(order) < here + width)).write.mode("append").parquet(path)
        start(t.spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


def _inbox(t) -> str:
    path = scratch_path(t.spark, "stream-inbox")
    key = F.col("s_suppkey").cast("string")

    def source(name: str):
        return F.concat(F.lit("data/"), key, F.lit(f"-{name}.csv")).alias(name)

    jobs = t["supplier"].select(
        F.lit("orders_check").alias("event_type"),
        source("input"),
        source("rules"),
        source("before"),
        F.when(F.col("s_nationkey") != 3, source("after")).alias("after"),
        F.col("s_name").alias("event_id"),
    )
    write_documents(jobs, path)
    return path


INBOX = """SELECT s_name AS external_id, CASE WHEN s_nationkey = 3 THEN 'missing:after' ELSE '' END AS error,
  'order_id' AS key FROM supplier"""


def _inbox_result(t, out: str) -> DataFrame:
    schema = "path string, raw_hash string, key string, external_id string, error string"
    drained = t.spark.read.schema(schema).parquet(out)
    return drained.select("external_id", F.coalesce("error", F.lit("")).alias("error"), "key")


@query("str_01_stream_inbox", INBOX)
def _(t):
    """The inbox is scanned twice; the second scan finds nothing new."""
    folder, out, checkpoint = _inbox(t), scratch_path(t.spark, "out"), scratch_path(t.spark, "check")
    for _ in range(2):
        st.stream_inbox(t.spark, folder, out, checkpoint).awaitTermination()
    return _inbox_result(t, out)


@query("str_02_stream_poll", INBOX)
def _(t):
    """A polling stream, stopped once it has caught up."""
    folder, out, checkpoint = _inbox(t), scratch_path(t.spark, "out"), scratch_path(t.spark, "check")
    stream = st.stream_poll(t.spark, folder, out, checkpoint, every="1 second")
    stream.processAllAvailable()
    stream.stop()
    return _inbox_result(t, out)


@query("str_03_stream_dedup", f"SELECT fingerprint, first_seq, external_id, duplicates FROM ({EVENTS}) AS events_found")
def _(t):
    valid = submissions.validated(t["receipts"], t["source_files"])
    receipts = valid.select("receipt_seq", "external_id", "fingerprint", "error")
    state, checkpoint = st.Dedup(t.spark, scratch_path(t.spark, "dedup")), scratch_path(t.spark, "check")
    _arriving(t, receipts, "receipt_seq", "receipt-stream", lambda rows: st.stream_dedup(rows, state, checkpoint))
    return state.result().withColumn("external_id", F.coalesce("external_id", F.lit("")))


@query(
    "str_04_stream_validate",
    "\nUNION ALL\n".join(
        f"SELECT * FROM ({sql}) AS part{place}"
        for place, sql in enumerate(
            (REQUIRED_ID, REQUIRED_EMAIL, EMAIL, NUMBER, MIN, MAX, INTEGER, MAX_REGION, ALLOWED, DATE)
        )
    ),
)
def _(t):
    accounts, out, checkpoint = t["accounts"], scratch_path(t.spark, "out"), scratch_path(t.spark, "check")
    local = {
        name: {k: x for k, x in rule.items() if k != "unique"}
        for name, rule in ACCOUNT_RULES["columns"].items()
        if name in accounts.columns
    }
    rules = {**ACCOUNT_RULES, "columns": local}
    _arriving(t, accounts, "record_no", "account-stream", lambda rows: st.stream_validate(rows, rules, out, checkpoint))
    schema = "row bigint, column string, code string, message string, value string"
    return t.spark.read.schema(schema).parquet(out).select(*FINDING_COLUMNS)


@query(
    "str_05_stream_unique",
    """SELECT record_no AS "row", first_record, item_key AS value FROM (SELECT *,
  min(record_no) OVER (PARTITION BY trim(item_key)) AS first_record FROM keyed_lines WHERE trim(item_key) <> '') AS seen
WHERE record_no > first_record""",
)
def _(t):
    state, checkpoint = st.Uniqueness(t.spark, scratch_path(t.spark, "unique"), "item_key"), scratch_path(t.spark, "check")
    _arriving(t, t["keyed_lines"], "record_no", "key-stream", lambda rows: st.stream_unique(rows, state, checkpoint))
    return state.result()


@query(
    "str_06_stream_compare",
    f"""SELECT CAST(1 AS BIGINT) AS snapshot_id, added, removed, changed, unchanged FROM ({SUMMARY}) AS there
UNION ALL SELECT CAST(2 AS BIGINT), removed, added, changed, unchanged FROM ({SUMMARY}) AS back""",
)
def _(t):
    """Three snapshots arrive: old, new, and old again."""
    rows = []
    for number, name in enumerate(("before_orders", "after_orders", "before_orders")):
        path = scratch_path(t.spark, "snapshot")
        t[name].write.parquet(path)
        rows.append((number, path))
    announced = t.spark.createDataFrame(rows, "snapshot_id bigint, path string")
    state, checkpoint = st.SnapshotChain(t.spark, scratch_path(t.spark, "chain"), "order_id"), scratch_path(t.spark, "check")
    _arriving(t, announced, "snapshot_id", "announcements", lambda rows: st.stream_compare(rows, state, checkpoint))
    return state.summaries.rows().select("snapshot_id", "added", "removed", "changed", "unchanged")


# A tenth of the rows reach the stream a third of the log after their time.
_ARRIVALS = """SELECT *, id + CASE WHEN k % 10 = 3 THEN (SELECT max(id) // 3 FROM delivery_log) ELSE 0 END AS arrival FROM (
  SELECT *, count(*) FILTER (event = 'claim') OVER (PARTITION BY job_id, generation ORDER BY id) AS budget FROM (
    SELECT *, count(*) FILTER (event = 'replay') OVER (PARTITION BY job_id ORDER BY id) AS generation
    FROM (SELECT *, sum(CASE WHEN event = 'claim' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY id) - attempts_ago AS attempt
      FROM delivery_log) AS n) AS g) AS b WHERE attempt > 0"""
_US = "epoch_us(at_time)"
_LEASED = f"""SELECT *, max(until) OVER w AS reach FROM (
  SELECT a.*, claim_us, claim_budget, {_US} AS us,
    {_US} + CASE WHEN event IN ('claim', 'heartbeat') THEN {LEASE_SECONDS * 1_000_000} ELSE 0 END AS until
  FROM ({_ARRIVALS}) AS a JOIN (SELECT job_id, attempt, {_US} AS claim_us, budget AS claim_budget
    FROM ({_ARRIVALS}) AS c WHERE event = 'claim') AS c USING (job_id, attempt)
  WHERE {_US} >= claim_us AND event <> 'replay') AS u
WINDOW w AS (PARTITION BY job_id, attempt ORDER BY us, CASE WHEN event = 'claim' THEN 0 ELSE 1 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
# Up to the first row at or after the reach of those before, all are within the lease.
_HELD = f"""SELECT *, sum(CASE WHEN us >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, attempt
  ORDER BY us, CASE WHEN event = 'claim' THEN 0 ELSE 1 END, id) AS lost FROM ({_LEASED}) AS l"""


def _lease_log(t) -> tuple[DataFrame, str]:
    """The log with attempts and budgets, out of order, run through the stream."""
    numbered = running(delivery.with_attempts(t["delivery_log"]), ["job_id"], "id", {"generation": Running(F.when(F.col("event") == "replay", 1).otherwise(0))})
    claims = Running(F.when(F.col("event") == "claim", 1).otherwise(0))
    counted = running(numbered, ["job_id", "generation"], "id", {"budget": claims}).filter("attempt > 0")
    third = t["delivery_log"].agg(F.max("id")).first()[0] or 0
    log = counted.select(
        "id", "job_id", F.col("attempt").cast("bigint").alias("attempt"), "event", F.col("at_time").cast("timestamp").alias("at_time"),
        F.col("budget").cast("int").alias("budget_attempts"), F.lit(MAX_ATTEMPTS).alias("max_attempts"),
        (F.col("id") + F.when(F.col("k") % 10 == 3, third // 3).otherwise(0)).alias("arrival"),
    )
    out, checkpoint = scratch_path(t.spark, "out"), scratch_path(t.spark, "check")
    _arriving(
        t, log, "arrival", "lease-stream",
        lambda rows: leases.stream_lease_timeout(rows.drop("arrival"), LEASE_SECONDS, out, checkpoint, late="0 seconds", keep_seconds=10**9),
    )
    return t.spark, out


@query(
    "str_07_stream_lease_timeout",
    f"""SELECT job_id, CAST(attempt AS BIGINT) AS attempt, strftime(make_timestamp(expiry), '%Y-%m-%dT%H:%M:%S.%f') AS expires_at, beats,
  CASE WHEN budget >= {MAX_ATTEMPTS} THEN 'DEAD_LETTER' ELSE 'QUEUED' END AS status_after, CAST(0 AS BIGINT) AS delay_seconds
FROM (SELECT job_id, attempt, max(claim_budget) AS budget, max(until) AS expiry, count(*) FILTER (event = 'heartbeat') AS beats,
    count(*) FILTER (event IN ('fail', 'settle')) AS endings FROM ({_HELD}) AS h WHERE lost = 0 GROUP BY job_id, attempt) AS held
WHERE endings = 0 AND expiry <= (SELECT max(epoch_us(at_time)) // 1000 * 1000 FROM ({_ARRIVALS}) AS every)""",
)
def _(t):
    """Leases nobody renewed or ended, decided by event time alone, though rows come
    late; replays open a new budget."""
    found = leases.lease_outcomes(*_lease_log(t))
    stamp = F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return found.select("job_id", "attempt", stamp.alias("expires_at"), "beats", "status_after", "delay_seconds")


@query(
    "str_07_stream_lease_late",
    f"""SELECT id, job_id, CAST(attempt AS BIGINT) AS attempt, event, true AS applied FROM (
  SELECT *, epoch_us(at_time) AS us, max(seen) OVER (ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
    SELECT *, max(epoch_us(at_time)) OVER (PARTITION BY part) // 1000 * 1000 AS seen FROM (
      SELECT *, (arrival - min(arrival) OVER ()) // ((max(arrival) OVER () - min(arrival) OVER ()) // {_PARTS} + 1) AS part
      FROM ({_ARRIVALS}) AS a) AS p) AS s) AS b
WHERE us < before""",
)
def _(t):
    """Rows that came behind the watermark, each listed once."""
    return leases.late_rows(*_lease_log(t)).select("id", "job_id", "attempt", "event", "applied")
