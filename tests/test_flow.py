"""From files to a briefing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import comparison, verification
from tabwarden.plans.flow import flow
from tabwarden.sources.delimited import read_export

RULES = '{"version":1,"columns":{"sku":{"required":true,"unique":true},"price":{"type":"number","min":0}}}'

RULES_V = '{"version":1,"columns":{"v":{"required":true}}}'


def test_files_to_briefing(spark, tmp_path):
    texts = {
        "export.csv": "sku,price,source\na,1,x\na,-2,x\n,3,x\n",
        "before.csv": "sku,price\na,1\nb,2\nc,3\n",
        "after.csv": "price,sku,new\n1,a,\n9,b,\n4,d,\n",
    }
    frames = {}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        frames[name] = read_export(spark, str(tmp_path / name))
    result = flow(frames["export.csv"], RULES, frames["before.csv"], frames["after.csv"], "sku", "r1")
    assert [(r.row, r.column, r.code) for r in result.findings.collect()] == [(3, "sku", "duplicate"), (3, "price", "min"), (4, "sku", "required")]
    moved = result.change_summary.first()
    assert (moved.added, moved.removed, moved.changed, moved.unchanged) == (1, 1, 1, 1)
    assert [(r.change, r.column) for r in result.schema_diff.collect()] == [("added", "new")]
    assert all(r.passed for r in result.checks.collect())
    assert [r.id for r in result.evidence.orderBy("place").collect()] == ["V1", "V2", "V3", "C1", "C2", "C3", "C4"]
    assert result.truncation.first().applied is False
    assert result.summary.first().summary.startswith("Quality check: 3 issues across 2 of 3 records.")
    assert {r.priority: r.evidence_ids for r in result.actions.collect()} == {"high": ["V1", "V2", "V3"], "medium": ["C1", "C2", "C3", "C4"]}


def _sides(spark):
    old = [(n + 2, f"k{n}", f"v{n}", None if n % 3 else "t") for n in range(300)]
    new = [(n + 2, f" k{n}", f"v{n}" if n % 50 else "other", None if n % 3 else "t") for n in range(5, 320)]
    schema = "record_no long, id string, v string, note string"
    return spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)


def test_one_comparison_answers_all_with_one_full_join(spark):
    before, after = _sides(spark)
    shape = comparison._shape(before, after, "id", ())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(comparison._kinds(before, after, shape)).count("FullOuter") == 1
    found = comparison.compared(before, after, "id")
    results = [found.summary(10), found.findings(10), found.images(), found.cells()]
    assert all("FullOuter" not in plan(df) for df in results)
    # Only records that differ are kept: images of unchanged ones never move.
    assert found.changes.count() == 5 + 20 + 5 and set(found.changes.columns) == {"__key", "kind", "old", "new"}
    for mine, single in zip(results, (
        comparison.diff_summary(before, after, "id", 10), comparison.diff_findings(before, after, "id", 10),
        comparison.row_images(before, after, "id"), comparison.cell_changes(before, after, "id"),
    ), strict=True):
        assert sorted(map(str, mine.collect())) == sorted(map(str, single.collect()))


def test_digests_see_nulls_and_compare_across_types(spark):
    a = spark.createDataFrame([(2, "x", None, "b", 1), (3, "y", "a", None, 2)], "record_no long, id string, p string, q string, n int")
    b = spark.createDataFrame([(2, "x", "b", None, 1), (3, "y", "a", None, 2)], "record_no long, id string, p string, q string, n long")
    kinds = comparison.compared(a, b, "id").kinds.collect()
    assert {r["__key"]: r.kind for r in kinds} == {"x": "changed", "y": "unchanged"}


def test_drift_is_located_to_its_block(spark):
    before, _ = _sides(spark)
    tree = lambda df: verification.fingerprint_tree(verification.block_fingerprints(df, F.floor(F.col("record_no") / 16)))
    altered = before.withColumn("v", F.when(F.col("record_no") == 170, "x").otherwise(F.col("v")))
    nodes = verification.drifted_nodes(tree(before), tree(altered)).collect()
    assert sorted((r.level, r.node) for r in nodes) == [(0, 10), (1, 0), (2, 0), (3, 0), (4, 0)]
    doubled = before.union(before.filter("record_no = 299"))
    assert {(r.level, r.node, r.rows_after) for r in verification.drifted_nodes(tree(before), tree(doubled)).collect()} >= {(0, 18, 15), (4, 0, 301)}
    assert verification.drifted_nodes(tree(before), tree(before.orderBy(F.desc("v")))).count() == 0


def test_flow_compares_stored_findings_and_inputs(spark, monkeypatch):
    before, after = _sides(spark)
    whole, trees = comparison.row_images, verification.fingerprint_tree
    seen = []

    def altered_later(blocks, **kinds):
        seen.append(blocks)
        more = F.when(F.col("source") == "after", 1).otherwise(0)
        return trees(blocks.withColumn("rows", F.col("rows") + more) if len(seen) > 1 else blocks, **kinds)

    monkeypatch.setattr(comparison, "row_images", lambda *a, **k: whole(*a, **k).filter("kind <> 'added'"))
    monkeypatch.setattr(verification, "fingerprint_tree", altered_later)
    result = flow(after, RULES_V, before, after, "id", "r2")
    broken = {(r.engine, r.check): r.violations for r in result.checks.collect() if not r.passed}
    assert broken == {("changes", "engine_recomputation"): 20, ("changes", "source_identity"): 1}
    assert {(r.source, r.level, r.node) for r in result.drift.collect()} == {("after", level, 0) for level in range(5)}
