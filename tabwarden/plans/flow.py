"""The whole check of one run: validate an export, compare two snapshots, verify
both by recomputation, and brief on the evidence."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.operators import briefing, comparison, evidence, validation, verification
from tabwarden.session import written

BY = ("run_id",)
#: Records of a block whose drift is located.
BLOCK_RECORDS = 65_536


@dataclass(frozen=True)
class FlowResult:
    quality_summary: DataFrame
    findings: DataFrame
    change_summary: DataFrame
    schema_diff: DataFrame
    cells: DataFrame
    checks: DataFrame
    drift: DataFrame
    evidence: DataFrame
    truncation: DataFrame
    summary: DataFrame
    actions: DataFrame


def _identities(inputs: dict[str, DataFrame]) -> DataFrame:
    """The fingerprint trees of the inputs, over ranges of their record numbers."""
    blocks: DataFrame | None = None
    for label, ds in inputs.items():
        some = verification.block_fingerprints(ds, F.floor(F.col("record_no") / BLOCK_RECORDS))
        some = some.select(F.lit(label).alias("source"), "*")
        blocks = some if blocks is None else blocks.unionByName(some)
    return verification.fingerprint_tree(blocks, by=["source"])


def flow(
    export: DataFrame,
    rules: Any,
    before: DataFrame,
    after: DataFrame,
    key: str,
    run_id: str,
    max_findings: int = 500,
) -> FlowResult:
    """Run all steps.

    The findings of both engines are written before anything reads them. Verification
    then computes them anew, the changes by a join of whole records where the stored
    ones came from digests, and fingerprints the inputs again: ``drift`` names the
    blocks of records that are not what they were when the run began.
    """
    comparison.check_key(before, after, key)
    run = F.lit(run_id).alias("run_id")
    inputs = {"export": export, "before": before, "after": after}
    tagged = [df.select(run, "*") for df in inputs.values()]
    checked = validation.check_rules(rules)

    received = written(_identities(inputs), "identities")

    def quality() -> tuple[DataFrame, DataFrame]:
        found = validation.all_findings(tagged[0], checked, by=BY)
        return found, validation.validation_summary(tagged[0], checked, max_findings, by=BY)

    findings, totals = (written(df, "quality") for df in quality())
    diff = comparison.compared(tagged[1], tagged[2], key, by=BY)
    changes = written(diff.images(), "change-findings")
    moved = written(diff.summary(max_findings), "changes")
    schema = comparison.schema_diff(before, after)
    results = evidence.RunResults(
        quality=findings,
        quality_summary=totals,
        changes=changes,
        change_summary=moved,
        schema=schema.select(run, "*"),
    )
    kept = evidence.evidence_budget(results)
    drift = written(verification.drifted_nodes(received, _identities(inputs), by=["source"]), "drift")
    fresh, fresh_totals = quality()
    fresh_changes = comparison.row_images(tagged[1], tagged[2], key, by=BY)
    fresh_moved = comparison.diff_summary(tagged[1], tagged[2], key, max_findings, by=BY)
    blocks = drift.filter("level = 0")
    return FlowResult(
        quality_summary=totals,
        findings=validation.findings_cap(findings, max_findings),
        change_summary=moved,
        schema_diff=schema,
        cells=diff.cells().drop("run_id"),
        checks=_engine("quality", verification.verification_checks(findings, fresh, totals, fresh_totals, blocks.filter("source = 'export'")))
        .unionByName(
            _engine(
                "changes",
                verification.verification_checks(
                    _flat(changes), _flat(fresh_changes), moved, fresh_moved, blocks.filter("source <> 'export'")
                ),
            )
        ),
        drift=drift,
        evidence=kept,
        truncation=evidence.truncation_metadata(results),
        summary=briefing.briefing_summary(results),
        actions=briefing.briefing_actions(results, kept),
    )


def _engine(name: str, checks: DataFrame) -> DataFrame:
    return checks.select(F.lit(name).alias("engine"), "*")


def _flat(images: DataFrame) -> DataFrame:
    """Maps as sorted entries, which can be grouped by."""
    entries = [F.array_sort(F.map_entries(name)).alias(name) for name in ("before", "after")]
    return images.select("run_id", "kind", "key", *entries, "fields")
