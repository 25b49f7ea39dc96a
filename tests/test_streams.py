from __future__ import annotations

import hashlib
import json
import random
from datetime import datetime, timedelta

from tabwarden.streaming import leases
from tabwarden.streaming import streams as st
from tabwarden.streaming.memory import KeyedTable

START = datetime(2024, 1, 1)


def test_inbox_restart_takes_only_new_documents(spark, tmp_path):
    inbox, out, check = (str(tmp_path / name) for name in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    schema = "path string, raw_hash string, key string, external_id string, error string"

    def scan():
        st.stream_inbox(spark, inbox, out, check, ".job.json").awaitTermination()
        return sorted((r.path.rsplit("/", 1)[-1], r.error) for r in spark.read.schema(schema).parquet(out).collect())

    (tmp_path / "in" / "a.job.json").write_text("{")
    (tmp_path / "in" / "skip.json").write_text("{}")
    assert scan() == [("a.job.json", "invalid_json")]
    good = {"event_type": "orders_check", **{n: "x.csv" for n in ("input", "rules", "before", "after")}}
    (tmp_path / "in" / "b.job.json").write_text(json.dumps(good))
    for _ in range(2):
        assert scan() == [("a.job.json", "invalid_json"), ("b.job.json", None)]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch tried again after a failure gives the same state."""
    state = st.Dedup(spark, str(tmp_path / "dedup"))
    schema = "receipt_seq bigint, external_id string, fingerprint string, error string"
    batches = [
        [(0, "x", "f1", None), (1, None, "f1", None), (2, "y", "f2", "bad")],
        [(3, "x", "f2", None), (4, "y", "f2", None), (5, None, "f1", None)],
    ]
    for number, rows in ((0, batches[0]), (1, batches[1]), (1, batches[1])):
        state.batch(spark.createDataFrame(rows, schema), number)
    assert sorted((r.fingerprint, r.first_seq, r.external_id, r.duplicates) for r in state.result().collect()) == [("f1", 0, "x", 2), ("f2", 4, "y", 0)]
    assert [r.receipt_seq for r in state.conflicts.rows().collect()] == [3]


def test_unique_names_first_record_across_batches(spark, tmp_path):
    state = st.Uniqueness(spark, str(tmp_path / "unique"), "v")
    for number, rows in enumerate(([(2, "a"), (3, " a"), (4, "")], [(5, "b"), (6, "a"), (7, None)], [(8, "b ")])):
        state.batch(spark.createDataFrame(rows, "record_no bigint, v string"), number)
    assert sorted((r.row, r.first_record) for r in state.found.rows().collect()) == [(3, 2), (6, 2), (8, 5)]


def test_batches_read_the_buckets_of_their_keys_only(spark, tmp_path):
    """Over many batches and runs of runs: the rows read follow the batch, whatever was
    kept before, and hold every row of the batch's keys."""
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, n long", "k", None, 2, 4, 64).create()
    keys = lambda ids: spark.createDataFrame([(f"key {i}",) for i in ids], "k string")
    read = []
    for batch in range(9):
        rows = spark.range(batch * 200, batch * 200 + 200).selectExpr("concat('key ', id % 1500) AS k", "id AS n")
        some = [5, 1499 - batch]
        found = table.touching(keys(some), batch)
        got = {(r.k, r.n) for r in found.collect()}
        read.append(found.count())
        want = {(f"key {i % 1500}", i) for i in range(batch * 200) if i % 1500 in some}
        assert want <= got and len(got) == read[-1]
        for _ in range(2 if batch in (4, 8) else 1):
            table.append(rows, batch)
            table.touching(keys(some), batch)  # tried again
    assert max(read) <= 3 * 200 and len(table._runs(8)) == 1 and len(table._runs(7)) == 3
    assert table.rows().count() == 1800 and table.touching(keys([]), 9).count() == 0


def test_long_stream_is_the_batch_result_with_merged_runs_and_late_firsts(spark, tmp_path):
    """Ten small batches in no order, some tried again, against all rows at once."""
    state = st.Uniqueness(spark, str(tmp_path / "u"), "v")
    state.firsts = KeyedTable(spark, str(tmp_path / "firsts"), state.firsts.schema, "v", st._least_records, 2, 2, 8).create()
    pick = random.Random(3)
    rows = [(n, pick.choice("abcdefgh ") * pick.randint(1, 2)) for n in range(60)]
    pick.shuffle(rows)
    for batch in range(10):
        part = spark.createDataFrame(rows[batch * 6 : batch * 6 + 6], "record_no bigint, v string")
        for _ in range(1 + (batch in (4, 7, 8))):
            state.batch(part, batch)
    first = {}
    for n, v in sorted(rows):
        first.setdefault(v.strip(), n)
    want = sorted((n, first[v.strip()]) for n, v in rows if v.strip() and first[v.strip()] < n)
    assert sorted((r.row, r.first_record) for r in state.result().collect()) == want


LOG = "id long, job_id string, attempt long, event string, at_time timestamp, budget_attempts int, max_attempts int"


class LeaseRun:
    """A lease stream over files that arrive one by one, restarted for each."""

    def __init__(self, spark, tmp_path, keep_seconds=3600):
        self.spark, self.keep = spark, keep_seconds
        self.inbox, self.out, self.check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def take(self, *rows):
        full = [(i, job, 1, event, START + timedelta(seconds=at), budget, most) for i, job, event, at, budget, most in rows]
        self.spark.createDataFrame(full, LOG).coalesce(1).write.mode("append").parquet(self.inbox)
        log = self.spark.readStream.schema(LOG).parquet(self.inbox)
        leases.stream_lease_timeout(log, 30, self.out, self.check, late="0 seconds", keep_seconds=self.keep).awaitTermination()
        found = leases.lease_outcomes(self.spark, self.out).collect()
        outcomes = {r.job_id: ((r.expires_at - START).total_seconds(), r.beats, r.status_after, r.delay_seconds, r.revision) for r in found}
        return outcomes, sorted((r.id, r.applied) for r in leases.late_rows(self.spark, self.out).collect())


def test_late_rows_correct_what_was_told(spark, tmp_path):
    run = LeaseRun(spark, tmp_path)
    claim = lambda i, job, at, budget=1: (i, job, "claim", at, budget, 2)
    outcomes, late = run.take(claim(1, "a", 0), claim(2, "b", 0, 2), claim(3, "c", 100))
    assert outcomes == {"a": (30, 0, "QUEUED", 0, 1), "b": (30, 0, "DEAD_LETTER", 0, 1)} and late == []
    # A beat and the settlement of "a" come behind the watermark, and two beats of "b" in the wrong order.
    outcomes, late = run.take((4, "a", "settle", 40, None, None), (5, "a", "heartbeat", 20, None, None), (6, "b", "heartbeat", 45, None, None), (7, "b", "heartbeat", 29, None, None))
    assert outcomes == {"b": (75, 2, "DEAD_LETTER", 0, 2)} and late == [(4, True), (5, True), (6, True), (7, True)]
    # Time alone moves on; a replay changes no lease.
    outcomes, late = run.take((8, "z", "replay", 129, None, None))
    assert set(outcomes) == {"b"}
    outcomes, late = run.take((9, "z", "replay", 130, None, None), (10, "b", "heartbeat", 75, None, None))
    assert outcomes == {"b": (75, 2, "DEAD_LETTER", 0, 2), "c": (130, 0, "QUEUED", 0, 1)} and (10, True) in late


def test_rows_after_the_kept_time_are_listed_only(spark, tmp_path):
    run = LeaseRun(spark, tmp_path, keep_seconds=60)
    run.take((1, "a", "claim", 0, 1, 2))
    run.take((2, "z", "claim", 500, 1, 2))
    outcomes, late = run.take((3, "a", "heartbeat", 20, None, None))
    assert outcomes == {"a": (30, 0, "QUEUED", 0, 1)} and late == [(3, False)]


def test_leases_in_many_parts_are_the_rule_of_each_attempt(spark, tmp_path):
    """Rows in any order and parts, with equal times, against the plain rule; a batch
    tried again changes nothing, and no task runs Python."""
    pick = random.Random(5)
    rows = []
    for job in range(60):
        rows += [(f"j{job}", event, pick.randrange(0, 240, 5)) for event in pick.choices(["claim", "heartbeat", "heartbeat", "settle", "replay"], k=7)]
    pick.shuffle(rows)
    full = [(n, job, event, START + timedelta(seconds=at), 1, 2) for n, (job, event, at) in enumerate(rows)]
    state = leases.Leases(spark, str(tmp_path / "out"), str(tmp_path / "state"), 30, 10**6, "0 seconds")
    schema = "id long, job_id string, event string, at_time timestamp, budget int, most int"
    for batch in range(10):
        part = spark.createDataFrame(full[batch * 42 : batch * 42 + 42], schema)
        part = part.selectExpr("job_id AS lease", "job_id", "1L AS attempt", "id", "event", "unix_micros(at_time) AS at", "budget", "most")
        for _ in range(1 + (batch in (3, 8))):
            state.batch(part, batch)
    known = {}
    for job, event, at in rows:  # times count from the start
        known.setdefault(job, leases.Attempt(None)).add(event, at * 1_000_000, 1, 2)
    end, want = max(at for _, _, at in rows) * 1_000_000, {}
    for job, it in known.items():
        expiry, beats = it.lease(30) if it.claim is not None else (end + 1, 0)
        if expiry <= end and not it.ended(expiry):
            want[job] = (expiry, beats)
    found = leases.lease_outcomes(spark, str(tmp_path / "out"))
    assert {r.job_id: (round((r.expires_at - START).total_seconds() * 1_000_000), r.beats) for r in found.collect()} == {
        job: (expiry, beats) for job, (expiry, beats) in want.items()
    }
    assert want and "Python" not in found._jdf.queryExecution().toString()


def test_lease_of_an_attempt():
    def lease(*rows):
        it = leases.Attempt(None)
        for event, at in rows:
            it.add(event, at, 1, 1)
        end, beats = it.lease(5)
        return end, beats, it.ended(end)

    s = 1_000_000
    assert lease(("claim", 0), ("heartbeat", 5 * s - 1)) == (10 * s - 1, 1, False)
    assert lease(("claim", 0), ("heartbeat", 5 * s)) == (5 * s, 0, False)
    assert lease(("claim", 0), ("settle", 4 * s)) == (5 * s, 0, True)
    assert lease(("settle", 5 * s), ("claim", 0)) == (5 * s, 0, False)
    assert lease(("heartbeat", -s), ("claim", 0), ("heartbeat", 8 * s), ("heartbeat", 4 * s)) == (13 * s, 2, False)


def test_bad_snapshots_are_recorded_and_passed_over(spark, tmp_path):
    rows = {0: [(2, "a", "1")], 1: [(2, "a", "1"), (3, "a", "2")], 2: [(2, " ", "1")], 3: [(2, "a", "9")]}
    paths = []
    for n, records in rows.items():
        spark.createDataFrame(records, "record_no long, id string, v string").write.parquet(str(tmp_path / f"s{n}"))
        paths.append((n, str(tmp_path / f"s{n}")))
    paths.append((4, str(tmp_path / "absent")))
    chain = st.SnapshotChain(spark, str(tmp_path / "state"), "id")
    for number, some in enumerate((paths[:2], paths[2:], paths[2:])):
        chain.batch(spark.createDataFrame(some, "snapshot_id long, path string"), min(number, 1))
    assert sorted(r.snapshot_id for r in chain.rejected.rows().collect()) == [1, 2, 4]
    assert [(r.snapshot_id, r.changed) for r in chain.summaries.rows().collect()] == [(3, 1)]


def test_oversized_documents_are_listed_unread(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.json").write_text('{"a": "' + "x" * 300 + '"}')
    (tmp_path / "in" / "small.json").write_text("{")
    out = str(tmp_path / "out")
    st.stream_inbox(spark, str(tmp_path / "in"), out, str(tmp_path / "check"), max_bytes=100).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.error, r.raw_hash is None) for r in rows) == [("big.json", "too_large", True), ("small.json", "invalid_json", False)]


def test_an_inbox_is_one_source_taken_in_bounded_batches(spark, tmp_path, monkeypatch):
    """Every document once, over several batches and starts, with its bytes as they are."""
    monkeypatch.setattr(st, "FILES_PER_BATCH", 3, raising=False)
    inbox, out, check = (str(tmp_path / name) for name in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    texts = {f"{n}.json": b"{" * (n + 1) for n in range(6)} | {"bad one.json": b"{\"\xff\"}", "big.json": b" " * 101}
    errors = dict.fromkeys(texts, "invalid_json") | {"bad one.json": "not_utf8", "big.json": "too_large"}

    def scan():
        stream = st.stream_inbox(spark, inbox, out, check, max_bytes=100)
        stream.awaitTermination()
        taken = [(len(p.sources), p.numInputRows) for p in stream.recentProgress if p.numInputRows]
        return taken, {r.path.rsplit("/", 1)[-1]: (r.raw_hash, r.error) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text)
    want = {
        name.replace(" ", "%20"): (None if name == "big.json" else hashlib.sha256(text).hexdigest(), errors[name])
        for name, text in texts.items()
    }
    taken, found, rows = scan()
    assert {n for n, _ in taken} == {1} and max(n for _, n in taken) <= 3 and sum(n for _, n in taken) == 8
    assert (found, rows) == (want, 8)
    (tmp_path / "in" / "late.json").write_bytes(b"[")
    taken, found, rows = scan()
    assert [n for _, n in taken] == [1] and rows == 9 and found["late.json"][1] == "invalid_json"
    assert scan()[2] == 9


def test_a_poll_goes_on_until_all_batches_are_taken(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FILES_PER_BATCH", 3, raising=False)
    (tmp_path / "in").mkdir()
    for n in range(10):
        (tmp_path / "in" / f"{n}.json").write_text("{")
    out = str(tmp_path / "out")
    stream = st.stream_poll(spark, str(tmp_path / "in"), out, str(tmp_path / "check"), every="0 seconds")
    stream.processAllAvailable()
    batches = [p.numInputRows for p in stream.recentProgress if p.numInputRows]
    stream.stop()
    assert max(batches) == 3 and sum(batches) == 10 and spark.read.parquet(out).distinct().count() == 10


def test_files_of_a_batch_share_tasks(spark, tmp_path):
    """Neither listing nor reading takes a task per few files; other settings hold, and
    the session of the caller keeps its own."""
    (tmp_path / "in").mkdir()
    for n in range(400):
        (tmp_path / "in" / f"{n}.json").write_text("{")
    before = spark.conf.getAll
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert st.inbox_stream(spark, str(tmp_path / "in")).sparkSession.conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
    stream = st.stream_inbox(spark, str(tmp_path / "in"), out, str(tmp_path / "check"))
    stream.awaitTermination()
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(stage) for job in seen.getJobIdsForGroup(stream.runId) for stage in seen.getJobInfo(job).stageIds]
    most = 4 * spark.sparkContext.defaultParallelism
    assert stages and max(stage.numTasks for stage in stages) <= most
    assert len(list((tmp_path / "out").glob("*.parquet"))) <= spark.sparkContext.defaultParallelism + 1
    assert spark.read.parquet(out).count() == 400 and spark.conf.getAll == before
