"""Evidence and briefings, the byte budget against a plain loop."""

from __future__ import annotations

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import briefing as b
from tabwarden.operators import evidence as e

QUALITY = "run_id string, row bigint, column string, code string, message string, value string, col_idx int, code_idx int"
CHANGES = "run_id string, kind string, key string, before map<string,string>, after map<string,string>, fields array<string>"
QUALITY_TOTALS = "run_id string, rows bigint, issues bigint, affected_rows bigint, reported_findings bigint"
CHANGE_TOTALS = (
    "run_id string, before_rows bigint, after_rows bigint, added bigint, removed bigint, changed bigint, "
    "unchanged bigint, total_changes bigint, reported_findings bigint"
)


def _results(spark, quality, changes, schema=(), issues=None, total=None):
    runs = sorted({r[0] for r in [*quality, *changes]})
    n_quality = {run: sum(r[0] == run for r in quality) for run in runs}
    n_changes = {run: sum(r[0] == run for r in changes) for run in runs}
    frame = spark.createDataFrame
    return e.RunResults(
        quality=frame(list(quality), QUALITY),
        quality_summary=frame([(r, 9, issues or n_quality[r], 1, n_quality[r]) for r in runs], QUALITY_TOTALS),
        changes=frame(list(changes), CHANGES),
        change_summary=frame([(r, 9, 9, 0, 0, n_changes[r], 0, total or n_changes[r], n_changes[r]) for r in runs], CHANGE_TOTALS),
        schema=frame(list(schema), "run_id string, change string, column string"),
    )


def _finding(run, n, value):
    return (run, n + 2, "c", "type", "m", value, 0, 2)


def _change(run, n, before, after, fields=("f",)):
    return (run, "changed", f"{n:03d}", before, after, list(fields))


def _ids(frame):
    return [r.id for r in frame.orderBy("run_id", "place").collect()]


def test_schema_entry_takes_the_first_change_number(spark):
    change = _change("r", 1, {"f": "1"}, {"f": "2"})
    finding = _finding("r", 1, "x")
    assert _ids(e.evidence_ids(_results(spark, [finding], [change]))) == ["V1", "C1"]
    results = _results(spark, [finding], [change], [("r", "added", "z")])
    assert _ids(e.evidence_budget(results)) == ["V1", "C1", "C2"]
    rows = e.evidence_budget(results).collect()
    payloads = {r.id: json.loads(r.payload) for r in rows}
    assert payloads["C1"] == {"id": "C1", "kind": "schema", "added": ["z"], "removed": []}
    assert payloads["C2"]["before"] == {"f": "1"}


def test_long_values_and_wide_records_are_cut_and_said_so(spark):
    wide = {f"n{i:02d}" * 200: "v" for i in range(25)}
    quality = [_finding("r", n, "w" * 1000) for n in range(30)]
    results = _results(spark, quality, [_change("r", 1, {}, None)])
    # A Python dict loses its order on the way; an engine map is built from arrays.
    image = F.map_from_arrays(F.array(*map(F.lit, wide)), F.array(*map(F.lit, wide.values())))
    results = replace(results, changes=results.changes.withColumn("before", image))
    rows = {r.id: json.loads(r.payload) for r in e.evidence_budget(results).collect()}
    assert len([i for i in rows if i.startswith("V")]) == 20
    assert rows["V1"]["value"] == "w" * 500 + "… [truncated]"
    assert list(rows["C1"]["before"]) == list(wide)[:20]
    assert rows["C1"]["after"] is None
    meta = e.truncation_metadata(results).first()
    assert (meta.quality_available, meta.quality_included, meta.applied) == (30, 20, True)


def test_omitted_findings_alone_are_disclosed(spark):
    few = _results(spark, [_finding("r", 1, "x")], [])
    assert e.truncation_metadata(few).first().applied is False
    more = _results(spark, [_finding("r", 1, "x")], [], issues=7)
    assert e.truncation_metadata(more).first().applied is True


# --- a plain loop over whole documents ------------------------------------------


def _compact(value):
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()


def _loop(quality, changes, schema):
    """Ids kept when the whole document is measured after every entry."""
    meta = {
        "applied": False, "max_findings_per_source": 20, "max_string_characters": 500,
        "max_collection_items": 20, "max_evidence_bytes": 65536,
        "quality_available_findings": len(quality), "quality_included_findings": 0,
        "change_available_findings": len(changes), "change_included_findings": 0,
        "schema_evidence_included": False,
    }
    totals = {"rows": 9, "issues": len(quality), "affected_rows": 1, "reported_findings": len(quality)}
    moved = {"before_rows": 9, "after_rows": 9, "added": 0, "removed": 0, "changed": len(changes), "unchanged": 0,
             "total_changes": len(changes), "reported_findings": len(changes)}
    document = {"quality_summary": totals, "change_summary": moved, "evidence": [], "truncation": meta}
    entries = [(f"V{n}", "quality", dict(zip(("row", "column", "code", "message", "value"), q[1:6], strict=True))) for n, q in enumerate(quality[:20], 1)]
    if schema:
        entries.append(("C1", "schema", {"kind": "schema", "added": [s[2] for s in schema], "removed": []}))
    shift = 1 if schema else 0
    entries += [(f"C{n + shift}", "change", dict(zip(("kind", "key", "before", "after", "fields"), c[1:], strict=True))) for n, c in enumerate(changes[:20], 1)]
    for name, source, body in entries:
        document["evidence"].append({**body, "id": name})
        if len(_compact(document)) > 65536 - 256:
            document["evidence"].pop()
        elif source == "schema":
            meta["schema_evidence_included"] = True
        else:
            meta[f"{source}_included_findings"] += 1
    return [entry["id"] for entry in document["evidence"]]


@pytest.mark.parametrize("seed", range(4))
def test_budget_agrees_with_measuring_whole_documents(spark, seed):
    rng = random.Random(seed)
    marks = ["a", "é", "漢", "\n", '"', "😀"]

    def text():
        return "".join(rng.choices(marks, k=rng.choice([5, 100, 499])))

    def record():
        return {f"f{i}": text() for i in range(rng.choice([1, 8, 20]))}

    quality = [_finding("r", n, text()) for n in range(rng.randint(0, 25))]
    changes = [_change("r", n, record(), rng.choice([None, record()])) for n in range(rng.randint(10, 25))]
    schema = [("r", "added", "z")] if seed % 2 else []
    expected = _loop(quality, changes, schema)
    assert _ids(e.evidence_budget(_results(spark, quality, changes, schema))) == expected


def test_actions_cite_the_first_kept_ids(spark):
    quality = [_finding("r", n, "x") for n in range(9)] + [_finding("s", 1, "x")]
    results = _results(spark, quality, [_change("r", 1, {"f": "1"}, {"f": "2"})])
    rows = b.briefing_actions(results, e.evidence_budget(results)).collect()
    found = {(r.run_id, r.priority): r.evidence_ids for r in rows}
    assert found == {("r", "high"): ["V1", "V2", "V3", "V4", "V5"], ("r", "medium"): ["C1"], ("s", "high"): ["V1"]}
    summary = {r.run_id: r.summary for r in b.briefing_summary(results).collect()}
    assert summary["r"].startswith("Quality check: 9 issues across 1 of 9 records. Snapshot comparison: 0 added, 0 removed, 1 changed,")


def test_revision_focus_follows_feedback(spark):
    rows = spark.createDataFrame([("r", 1, "base", "Explain the SNAPSHOT"), ("r", 2, "base", "why rows?")], "run_id string, number int, original_summary string, feedback string")
    found = {r.number: (r.focus, r.sections[0], r.summary) for r in b.revision_sections(rows).collect()}
    assert found[1][:2] == ("changes", "Snapshot changes by order ID")
    assert found[2][:2] == ("validation", "Validation issues by source record")
    assert found[2][2].startswith("base\n\nRevision 2: see the validation details first.")


BRIEFINGS = {
    '{"summary":"s","actions":[]}': "",
    '{"summary":"s","actions":[{"title":"t","priority":"low","evidence_ids":["V1"]}]}': "",
    '{"summary":"s","actions":[{"title":"t","priority":"low","evidence_ids":["V2"]}]}': "evidence_ids",
    '{"summary":"s","actions":[{"title":"t","priority":"low","evidence_ids":["V1","V1"]}]}': "evidence_ids",
    '{"summary":"s","actions":[{"title":"t","priority":"low","evidence_ids":"V1"}]}': "evidence_ids",
    '{"summary":"s","actions":[{"title":"","priority":"low","evidence_ids":["V1"]}]}': "title",
    '{"summary":"s","actions":[{"title":"t","priority":"LOW","evidence_ids":["V1"]}]}': "priority",
    '{"summary":"s","actions":[{"title":"t","priority":"low"}]}': "action_keys",
    '{"summary":"s","actions":[7]}': "action_keys",
    '{"summary":"s","actions":null}': "actions",
    '{"summary":"s","actions":[' + ",".join(["{}"] * 11) + "]}": "actions",
    '{"summary":7,"actions":[]}': "summary",
    '{"summary":"s","summary":"t","actions":[]}': "invalid_json",
    '{"summary":"s","actions":[]} ': "",
    '"s"': "not_an_object",
}


def test_proposed_briefings(spark):
    rows = [("r", n, text) for n, text in enumerate(BRIEFINGS)]
    evidence = spark.createDataFrame([("r", "V1")], "run_id string, id string")
    found = b.citation_check(spark.createDataFrame(rows, "run_id string, briefing_id bigint, content string"), evidence)
    assert [r.problem for r in found.orderBy("briefing_id").collect()] == list(BRIEFINGS.values())


def test_reviews(spark):
    rows = [
        ("a", 1, '{"approved":false,"feedback":"more"}'), ("a", 2, '{"approved":true,"feedback":""}'),
        ("b", 1, '{"approved":1,"feedback":"x"}'), ("b", 2, '{"approved":false,"feedback":""}'), ("b", 3, '{"approved":true,"feedback":""}'),
        ("c", 1, '{"approved":true,"feedback":"' + "x" * 2001 + '"}'),
    ]
    frame = spark.createDataFrame(rows, "run_id string, round bigint, content string")
    found = {r.run_id: (r.approved, r.rounds, r.last_feedback) for r in b.review_outcome(frame).collect()}
    assert found == {"a": (True, 2, None), "b": (False, 2, "rejection without feedback"), "c": (False, 1, "unusable feedback")}
    history = spark.createDataFrame(
        [("a", 1, True, "y" * 3000), ("a", 2, None, "x"), ("a", 3, False, "z"), ("a", 4, True, "late")],
        "run_id string, round bigint, approved boolean, feedback string",
    )
    assert sorted((r.round, len(r.feedback)) for r in b.review_history_bound(history).collect()) == [(1, 2000), (3, 1)]
