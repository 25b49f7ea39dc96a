"""Briefings from evidence, their revisions, and checks of proposed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.staging import evaluated
from tabwarden.functions.text import strip
from tabwarden.operators.evidence import RunResults, schema_lists
from tabwarden.sources.rule_docs import json_kind, strict_json

# The sentences of a briefing.
SUMMARY_FORMAT = (
    "Quality check: %d issues across %d of %d records. "
    "Snapshot comparison: %d added, %d removed, %d changed, and %d unchanged records. "
    "Schema: %d added and %d removed columns. "
    "Totals include findings omitted from the detailed samples."
)
QUALITY_ACTION = ("Review the validation findings before importing this export.", "high")
CHANGE_ACTION = ("Review the snapshot changes against the expected business updates.", "medium")
REVISION_FORMAT = (
    "%s\n\nRevision %d: see the %s details first. "
    "Validation details identify source rows, fields, values, and rule explanations; "
    "snapshot details identify order keys, changed fields, and before/after values."
)
SECTION_TITLES = {
    "validation": "Validation issues by source record",
    "changes": "Snapshot changes by order ID",
}
CHANGE_WORDS = ("change", "snapshot")

# Bounds of proposed briefings and reviews.
MAX_CITED = 5
MAX_SUMMARY = 4000
MAX_ACTIONS = 10
MAX_TITLE = 240
MAX_IDS = 20
PRIORITIES = ("high", "medium", "low")
MAX_FEEDBACK = 2000
MAX_ROUNDS = 2
KEPT_ROUNDS = 3


def _totals(results: RunResults) -> DataFrame:
    quality = results.quality_summary.select("run_id", "rows", "issues", "affected_rows")
    changes = results.change_summary.select(
        "run_id", "added", "removed", "changed", "unchanged", "total_changes"
    )
    lists = schema_lists(results.schema).select(
        "run_id", F.size("added").alias("columns_added"), F.size("removed").alias("columns_removed")
    )
    joined = quality.join(changes, "run_id", "full_outer").join(lists, "run_id", "left")
    zero = F.lit(0).cast("bigint")
    counts = [name for name in joined.columns if name != "run_id"]
    return joined.select(
        "run_id", *[F.coalesce(F.col(name).cast("bigint"), zero).alias(name) for name in counts]
    )


def briefing_summary(results: RunResults) -> DataFrame:
    numbers = (
        "issues", "affected_rows", "rows", "added", "removed", "changed", "unchanged",
        "columns_added", "columns_removed",
    )
    text = F.format_string(SUMMARY_FORMAT, *[F.col(name) for name in numbers])
    return _totals(results).select("run_id", text.alias("summary"))


def briefing_actions(results: RunResults, included: DataFrame) -> DataFrame:
    """Follow-up actions of each run, each citing its first evidence ids."""

    def cited(prefix: str) -> Column:
        entry = F.when(F.col("id").startswith(prefix), F.struct("place", "id"))
        return F.slice(F.array_sort(F.collect_list(entry)), 1, MAX_CITED)["id"]

    ids = included.groupBy("run_id").agg(cited("V").alias("quality_ids"), cited("C").alias("change_ids"))
    joined = _totals(results).join(ids, "run_id")
    changed = (F.col("total_changes") + F.col("columns_added") + F.col("columns_removed")) > 0

    def action(place: int, needed: Column, ids: str, wording: tuple[str, str]) -> Column:
        entry = F.struct(
            F.lit(place).alias("place"),
            F.lit(wording[0]).alias("title"),
            F.lit(wording[1]).alias("priority"),
            F.col(ids).alias("evidence_ids"),
        )
        return F.when(needed & (F.size(ids) > 0), entry)

    actions = F.array(
        action(1, F.col("issues") > 0, "quality_ids", QUALITY_ACTION),
        action(2, changed, "change_ids", CHANGE_ACTION),
    )
    rows = joined.select("run_id", F.explode(actions).alias("action"))
    return rows.filter(F.col("action").isNotNull()).select("run_id", "action.*")


def revision_sections(briefings: DataFrame) -> DataFrame:
    """Revised summaries from ``(run_id, number, original_summary, feedback)``.

    Feedback chooses which details come first. The original summary is repeated
    unchanged, so revisions do not pile up.
    """
    lowered = F.lower("feedback")
    about_changes = F.lit(False)
    for word in CHANGE_WORDS:
        about_changes = about_changes | lowered.contains(word)
    focus = F.when(about_changes, "changes").otherwise("validation")
    titles = [F.lit(SECTION_TITLES[name]) for name in ("validation", "changes")]
    first = F.when(about_changes, titles[1]).otherwise(titles[0])
    second = F.when(about_changes, titles[0]).otherwise(titles[1])
    text = F.format_string(REVISION_FORMAT, F.col("original_summary"), F.col("number"), focus)
    return briefings.select(
        "run_id",
        "number",
        focus.alias("focus"),
        F.array(first, second).alias("sections"),
        text.alias("summary"),
    )


def _text(value: Column, path: str) -> Column:
    """Text at ``path``; NULL if it is not text."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(json_kind(found) == "string", F.try_variant_get(value, path, "string"))


def _keys(value: Column) -> Column:
    return F.array_sort(F.json_object_keys(F.to_json(value)))


def _listed(*names: str) -> Column:
    return F.array(*[F.lit(name) for name in sorted(names)])


def citation_check(briefings: DataFrame, evidence: DataFrame) -> DataFrame:
    """First problem of each proposed briefing ``(run_id, briefing_id, content)``;
    empty if it may be used. ``evidence`` is ``(run_id, id)``.

    A run has 41 evidence ids at most, so they travel as one list per run.
    """
    ids = evidence.groupBy("run_id").agg(F.collect_set("id").alias("known_ids"))
    keep = ("run_id", "briefing_id")
    parsed = evaluated(briefings, *keep, strict_json(F.col("content")).alias("v"))
    v = F.col("v")
    opened = evaluated(
        parsed,
        *keep,
        json_kind(v).alias("kind"),
        _keys(v).alias("keys"),
        _text(v, "$.summary").alias("summary"),
        json_kind(F.try_variant_get(v, "$.actions", "variant")).alias("actions_kind"),
        F.try_variant_get(v, "$.actions", "array<variant>").alias("actions"),
    )

    def usable(text: Column, limit: int) -> Column:
        return F.coalesce((strip(text) != "") & (F.length(text) <= limit), F.lit(False))

    # Any number of briefings may belong to one run; runs with ids are one row each.
    joined = opened.join(ids, "run_id", "left")
    known = F.coalesce("known_ids", F.array().cast("array<string>"))

    def action_problem(action: Column) -> Column:
        cited = F.try_variant_get(action, "$.evidence_ids", "array<variant>")
        texts = F.transform(cited, lambda item: _text(item, "$"))
        listed = json_kind(F.try_variant_get(action, "$.evidence_ids", "variant")) == "array"
        counted = F.size(cited).between(1, MAX_IDS)
        all_known = F.forall(texts, lambda one: F.coalesce(F.array_contains(known, one), F.lit(False)))
        distinct = F.size(F.array_distinct(texts)) == F.size(texts)
        good_ids = F.coalesce(listed & counted & all_known & distinct, F.lit(False))
        right_keys = F.coalesce(
            (json_kind(action) == "object") & (_keys(action) == _listed("title", "priority", "evidence_ids")),
            F.lit(False),
        )
        return (
            F.when(~right_keys, "action_keys")
            .when(~usable(_text(action, "$.title"), MAX_TITLE), "title")
            .when(~F.coalesce(_text(action, "$.priority").isin(*PRIORITIES), F.lit(False)), "priority")
            .when(~good_ids, "evidence_ids")
        )

    of_actions = F.get(F.array_compact(F.transform("actions", action_problem)), F.lit(0))
    problem = (
        F.when(F.col("kind").isNull(), "invalid_json")
        .when(F.col("kind") != "object", "not_an_object")
        .when(F.col("keys") != _listed("summary", "actions"), "wrong_keys")
        .when(~usable(F.col("summary"), MAX_SUMMARY), "summary")
        .when((F.col("actions_kind") != "array") | (F.size("actions") > MAX_ACTIONS), "actions")
        .otherwise(of_actions)
    )
    return joined.select(*keep, F.coalesce(problem, F.lit("")).alias("problem"))


def judged_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews ``(run_id, round, content)`` with their verdict and feedback; a
    malformed review is a rejection that says why."""
    parsed = evaluated(reviews, "run_id", "round", strict_json(F.col("content")).alias("v"))
    v = F.col("v")
    opened = evaluated(
        parsed,
        "run_id",
        "round",
        (json_kind(v) == "object").alias("is_object"),
        _keys(v).alias("keys"),
        (json_kind(F.try_variant_get(v, "$.approved", "variant")) == "boolean").alias("is_flag"),
        F.try_variant_get(v, "$.approved", "boolean").alias("flag"),
        _text(v, "$.feedback").alias("text"),
    )
    shaped = F.col("is_object") & (F.col("keys") == _listed("approved", "feedback")) & F.col("is_flag")
    sized = F.length("text") <= MAX_FEEDBACK
    explained = F.col("flag") | (strip(F.col("text")) != "")
    yes = F.lit(True)
    problem = (
        F.when(~F.coalesce(shaped, ~yes), "malformed review")
        .when(~F.coalesce(sized, ~yes), "unusable feedback")
        .when(~F.coalesce(explained, ~yes), "rejection without feedback")
    )
    return opened.select("run_id", "round", problem.alias("problem"), "flag", "text").select(
        "run_id",
        "round",
        (F.col("problem").isNull() & F.col("flag")).alias("approved"),
        F.coalesce("problem", "text").alias("feedback"),
    )


def review_outcome(reviews: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Per run the first approved round, or that the rounds ran out and the last
    feedback."""
    judged = judged_reviews(reviews.filter(F.col("round") <= max_rounds))
    approved = F.when(F.col("approved"), F.col("round"))
    outcome = judged.groupBy("run_id").agg(
        F.min(approved).alias("approved_round"),
        F.max("round").alias("last_round"),
        F.max_by("feedback", "round").alias("last_feedback"),
    )
    done = F.col("approved_round").isNotNull()
    return outcome.select(
        "run_id",
        done.alias("approved"),
        F.coalesce("approved_round", "last_round").alias("rounds"),
        F.when(~done, F.col("last_feedback")).alias("last_feedback"),
    )


def review_history_bound(history: DataFrame) -> DataFrame:
    """Of the first rounds of each run, the well-formed ones, feedback shortened.

    The cut is pushed below the shuffle, so long histories do not travel.
    """
    order = Window.partitionBy("run_id").orderBy("round")
    first = history.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= KEPT_ROUNDS)
    formed = F.col("round").isNotNull() & F.col("approved").isNotNull() & F.col("feedback").isNotNull()
    return first.filter(formed).select(
        "run_id", "round", "approved", F.left("feedback", F.lit(MAX_FEEDBACK)).alias("feedback")
    )
