"""Cases that once gave wrong answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators.verification import table_fingerprint
from tabwarden.sources.rule_docs import strict_json
from tabwarden.sources.sinks import write_result
from tabwarden.streaming.streams import SnapshotChain


def test_a_second_run_leaves_the_first(spark, tmp_path):
    for run in ("r1", "r2", "r2"):
        frame = spark.createDataFrame([(run, 1)], "run_id string, n int")
        write_result({"findings": frame}, str(tmp_path), partition_by=["run_id"])
    rows = spark.read.json(str(tmp_path / "findings")).groupBy("run_id").count().collect()
    assert {(r.run_id, r["count"]) for r in rows} == {("r1", 1), ("r2", 1)}


def test_a_document_cannot_end_itself(spark):
    texts = ['{"a":1}', '{"a":1},"~end~"] trailing garbage', '{"a":1} x', '{"a":1},2']
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    good = rows.filter(strict_json(F.col("text")).isNotNull()).collect()
    assert [r.n for r in good] == [0]


def test_fingerprints_see_where_nulls_are(spark):
    tables = [spark.createDataFrame([row], "a string, b string") for row in ((None, "x"), ("x", None), (None, None), ("", "x"))]
    assert len({tuple(table_fingerprint(t).first()) for t in tables}) == 4


def test_every_snapshot_of_a_batch_is_compared(spark, tmp_path):
    paths = []
    for n in range(4):
        path = str(tmp_path / f"snapshot{n}")
        rows = [(i + 2, str(i), "x" * n) for i in range(3 + n)]
        spark.createDataFrame(rows, "record_no long, id string, v string").write.parquet(path)
        paths.append((n, path))
    chain = SnapshotChain(spark, str(tmp_path / "state"), "id")
    chain.batch(spark.createDataFrame(paths[:3], "snapshot_id long, path string"), 0)
    chain.batch(spark.createDataFrame(paths[3:], "snapshot_id long, path string"), 1)
    diffs = spark.read.parquet(chain.diffs)
    assert sorted(r.snapshot_id for r in diffs.select("snapshot_id").distinct().collect()) == [1, 2, 3]


def test_gates_do_not_fail_a_run(spark):
    from tabwarden.operators import run_history

    rows = [("r", step, "succeeded", None) for step in run_history.PLAN] + [("r", "approval_gate", "waiting", None)]
    rolled = run_history.run_rollup(spark.createDataFrame(rows, "run_id string, task_id string, status string, error string"))
    assert [(r.run_id, r.status, r.failure_reason) for r in rolled.collect()] == [("r", "SUCCEEDED", None)]


def test_beats_after_an_ending_or_a_newer_claim_are_void(spark):
    from datetime import datetime, timedelta

    from tabwarden.operators import delivery

    start = datetime(2024, 1, 1)
    rows = [("a", 0, "claim", 0), ("a", 10, "settle", 0), ("a", 20, "heartbeat", 0)]
    rows += [("b", 0, "claim", 0), ("b", 5, "heartbeat", 0), ("b", 6, "fail", 0), ("b", 7, "claim", 0), ("b", 8, "heartbeat", 1)]
    log = spark.createDataFrame(
        [(n, job, event, start + timedelta(seconds=at), ago) for n, (job, at, event, ago) in enumerate(rows)],
        "id bigint, job_id string, event string, at_time timestamp_ntz, attempts_ago int",
    )
    found = {(r.job_id, r.attempt): (r.valid_beats, r.void_beats, (r.expires_at - start).seconds) for r in delivery.effective_lease(log, 30).collect()}
    assert found == {("a", 1): (0, 1, 30), ("b", 1): (1, 1, 35), ("b", 2): (0, 0, 37)}


def test_a_late_smaller_record_becomes_the_first(spark, tmp_path):
    from tabwarden.streaming.streams import Uniqueness

    state = Uniqueness(spark, str(tmp_path / "unique"), "v")
    for number, rows in ((0, [(10, "a"), (12, "a ")]), (1, [(5, "a"), (7, "b")]), (2, [(3, "b"), (6, "a")]), (2, [(3, "b"), (6, "a")])):
        state.batch(spark.createDataFrame(rows, "record_no bigint, v string"), number)
    found = sorted((r.row, r.first_record, r.value) for r in state.result().collect())
    assert found == [(6, 5, "a"), (7, 3, "b"), (10, 5, "a"), (12, 5, "a ")]


def test_bounds_beyond_fixed_decimals_are_compared(spark):
    from tabwarden.sources.rule_docs import rule_catalog

    bounds = {"crossed": ("1e30", "1"), "fine": ("1", "1e30"), "negative": ("-1e30", "-2e30"), "equal": ("1e30", "1e30"), "small": ("2e-25", "1e-25")}
    docs = [(k, '{"version":1,"columns":{"a":{"type":"number","min":%s,"max":%s}}}' % b) for k, b in bounds.items()]
    _, lint = rule_catalog(spark.createDataFrame(docs, "rule_set string, doc string"))
    assert {(r.rule_set, r.code) for r in lint.collect()} == {(k, "min_exceeds_max") for k in ("crossed", "negative", "small")}


def test_a_null_group_is_checked_like_any_other(spark, monkeypatch):
    from tabwarden.operators import validation

    rows = [(2, None, "x"), (3, None, "x"), (4, "g", "x"), (5, "g", "y")]
    ds = spark.createDataFrame(rows, "record_no bigint, run_id string, n string")
    rules = {"version": 1, "columns": {"n": {"unique": True}}}
    for limit in (validation.BROADCAST_ROWS, -1):
        monkeypatch.setattr(validation, "BROADCAST_ROWS", limit)
        found = validation.all_findings(ds, rules, by=["run_id"]).collect()
        assert [(f.run_id, f.row, f.code) for f in found] == [(None, 3, "duplicate")]


def test_the_logged_flag_says_whether_a_retry_is_due(spark):
    from tabwarden.operators.run_history import retry_audit

    details = ['{"error":"RemoteDisconnected: x","retryable":true}', '{"error":"TimeoutError: x","retryable":false}', '{"error":"TimeoutError: x"}', '{"error":"ValueError: x"}']
    rows = []
    for n, detail in enumerate(details):
        rows += [(2 * n, f"r{n}", "planner", "task_started", "{}"), (2 * n + 1, f"r{n}", "planner", "task_failed", detail)]
    log = spark.createDataFrame(rows, "id bigint, run_id string, task string, event string, detail_json string")
    assert [r.expected for r in retry_audit(log).orderBy("id").collect()] == [True, False, True, False]


def test_streams_refuse_rules_they_cannot_check(spark, tmp_path):
    import pytest

    from tabwarden.streaming.streams import stream_validate

    rows = spark.createDataFrame([(2, "x")], "record_no bigint, a string")
    for columns in ({"a": {"unique": True}}, {"b": {"required": True}}):
        with pytest.raises(ValueError, match="in a stream"):
            stream_validate(rows, {"version": 1, "columns": columns}, str(tmp_path / "out"), str(tmp_path / "check"))


def test_drift_of_paths_that_stand_in_several_rows(spark):
    from tabwarden.operators.verification import input_drift

    receipts = [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "1"), ("d", "1")]
    current = [("a", "2"), ("a", "1"), ("b", "1"), ("b", "3"), ("d", "1"), ("d", "1")]
    frames = [spark.createDataFrame(rows, "path string, sha256 string") for rows in (receipts, current)]
    found = sorted((r.path, r.problem) for r in input_drift(*frames).collect())
    assert found == [("b", "changed"), ("c", "missing"), ("c", "missing")]


def test_source_identity_counts_receipts_once_where_paths_repeat(spark):
    from tabwarden.operators import verification

    make = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    drift = verification.input_drift(make([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]), make([("a", "1"), ("a", "2"), ("b", "3"), ("b", "4")]))
    same = spark.createDataFrame([(1,)], "v int")
    checks = {r.check: (r.violations, r.passed) for r in verification.verification_checks(same, same, same, same, drift).collect()}
    assert checks.pop("source_identity") == (2, False) and set(checks.values()) == {(0, True)}


def test_every_page_with_an_anchor_drifts_whatever_it_holds(spark, tmp_path):
    import duckdb

    from tabwarden.plans import QUERIES
    from tests.compare_all import differences

    htmls = [None, "", "<P>UPPER 1</P>", "<p>lower</p>", "<P>LOWER</P>"]
    pages = [(n, "http://a/1#top", html) for n, html in enumerate(htmls)]
    pages += [(n + 10, f"http://a/{n}", html) for n, html in enumerate(htmls)] + [(20, "http://a/1?p=2", None), (21, None, "x")]
    customers = [(n, f"Customer#{n}", n, 10.5 * n, "BUILDING") for n in range(12)]
    con = duckdb.connect()
    for name, rows, schema in (
        ("pages", pages, "page_id bigint, url string, html string"),
        ("customer", customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("ver_03_verification_checks", "ver_02_input_drift"):
        assert differences(spark, con, str(tmp_path), name) is None
    checks = QUERIES["ver_03_verification_checks"].sql
    assert ("source_identity", 5, False) in con.execute(checks).fetchall()
