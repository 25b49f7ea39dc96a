"""Bounded evidence of many runs at once, grouped by ``run_id``.

Inputs are findings and summaries of the checks and comparisons of each run. At
most twenty findings per source and run are kept before anything is collected,
and that cut is pushed below the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.session import written

# Bounds of the evidence of one run, and how cuts are marked.
MAX_EVIDENCE_BYTES = 64 * 1024
RESERVED_BYTES = 256
MAX_FINDINGS = 20
MAX_ITEMS = 20
MAX_CHARACTERS = 500
CUT_MARK = "… [truncated]"
MAX_DEPTH = 5
DEEP_OBJECT = "[nested object omitted]"
DEEP_LIST = "[nested list omitted]"

_QUALITY_ORDER = ("row", "col_idx", "code_idx")
_JSON = {"ignoreNullFields": "false"}
_ENTRY = ("run_id", "place", "source", "id", "payload", "trimmed")


@dataclass(frozen=True)
class RunResults:
    """What the checks of many runs found.

    ``quality``: ``run_id, row, column, code, message, value, col_idx, code_idx``;
    ``changes``: ``run_id, kind, key, before, after, fields``;
    ``schema``: ``run_id, change, column``; the summaries have one row per run.
    """

    quality: DataFrame
    quality_summary: DataFrame
    changes: DataFrame
    change_summary: DataFrame
    schema: DataFrame


# --- bounding ------------------------------------------------------------------


def bounded_text(value: Column) -> Column:
    cut = F.concat(F.left(value, F.lit(MAX_CHARACTERS)), F.lit(CUT_MARK))
    return F.when(F.length(value) > MAX_CHARACTERS, cut).otherwise(value)


def text_is_cut(value: Column) -> Column:
    return F.coalesce(F.length(value) > MAX_CHARACTERS, F.lit(False))


def bounded_list(values: Column) -> Column:
    return F.transform(F.slice(values, 1, MAX_ITEMS), bounded_text)


def list_is_cut(values: Column) -> Column:
    kept = F.slice(values, 1, MAX_ITEMS)
    return F.coalesce((F.size(values) > MAX_ITEMS) | F.exists(kept, text_is_cut), F.lit(False))


def bounded_map(values: Column) -> Column:
    """The first items of a record; names are kept whole, as cutting them could
    merge columns."""
    kept = F.slice(F.map_entries(values), 1, MAX_ITEMS)
    return F.map_from_entries(
        F.transform(kept, lambda e: F.struct(e["key"].alias("key"), bounded_text(e["value"]).alias("value")))
    )


def map_is_cut(values: Column) -> Column:
    kept = F.slice(F.map_entries(values), 1, MAX_ITEMS)
    return F.coalesce(
        (F.size(values) > MAX_ITEMS) | F.exists(kept, lambda e: text_is_cut(e["value"])), F.lit(False)
    )


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.to_json(text.cast("variant"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all that ``use`` does with it."""
    return F.transform(F.array(value), use)[0]


def _cell(shown: Column, trimmed: Column) -> Column:
    return F.struct(shown.alias("shown"), trimmed.alias("trimmed"))


def _bounded_level(value: Column, depth: int) -> Column:
    kind = F.schema_of_variant(value)
    is_object, is_list = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    text = value.try_cast("string")
    text_cell = _cell(_quoted(bounded_text(text)), text_is_cut(text))
    plain = F.when(kind == "STRING", text_cell).otherwise(_cell(F.coalesce(F.to_json(value), F.lit("null")), F.lit(False)))
    if depth >= MAX_DEPTH:
        marker = F.when(is_object, F.lit(f'"{DEEP_OBJECT}"')).otherwise(F.lit(f'"{DEEP_LIST}"'))
        return F.when(is_object | is_list, _cell(marker, F.lit(True))).otherwise(plain)
    entry = "array<struct<key:string,value:variant>>"
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")).cast(entry)
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda item: F.struct(F.lit(None).cast("string").alias("key"), item.alias("value")),
    ).cast(entry)

    def joined(size: Column, kept: Column) -> Column:
        pairs = F.transform(kept, lambda c: F.concat(_quoted(c["key"]), F.lit(":"), c["cell"]["shown"]))
        object_text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        list_text = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda c: c["cell"]["shown"]), ","), F.lit("]"))
        cut = (size > MAX_ITEMS) | F.exists(kept, lambda c: c["cell"]["trimmed"])
        return _cell(F.when(is_object, object_text).otherwise(list_text), cut)

    def bounded(entries: Column) -> Column:
        kept = F.transform(
            F.slice(entries, 1, MAX_ITEMS),
            lambda e: F.struct(e["key"].alias("key"), _bounded_level(e["value"], depth + 1).alias("cell")),
        )
        return _let(kept, lambda cells: joined(F.size(entries), cells))

    nested = _let(F.when(is_object, fields).otherwise(items), bounded)
    return F.when(is_object | is_list, nested).otherwise(plain)


def bounded_json(value: Column) -> Column:
    """Struct ``(shown, trimmed)``: a nested VARIANT as JSON of bounded depth and size.

    Level by level, objects and lists keep their first ``MAX_ITEMS`` items, texts
    their first ``MAX_CHARACTERS`` characters, and what is nested ``MAX_DEPTH`` deep is
    replaced by a marker. Names are kept whole. Items of an object are taken in order
    of their names, as a variant keeps no other. A missing value is shown as null.
    """
    none = _cell(F.lit("null"), F.lit(False))
    return F.when(value.isNull(), none).otherwise(_let(value, lambda v: _bounded_level(v, 0)))


# --- entries -------------------------------------------------------------------


def _first(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first findings of each run, numbered from 1."""
    ranked = df.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    return ranked.filter(F.col("n") <= MAX_FINDINGS)


def _quality_entries(results: RunResults) -> DataFrame:
    first = _first(results.quality, [F.asc_nulls_first("row"), F.col("col_idx"), F.col("code_idx")])
    name = F.concat(F.lit("V"), F.col("n").cast("string"))
    texts = ("column", "code", "message", "value")
    payload = F.struct("row", *[bounded_text(F.col(t)).alias(t) for t in texts], name.alias("id"))
    cut = F.lit(False)
    for text in texts:
        cut = cut | text_is_cut(F.col(text))
    return first.select(
        "run_id",
        F.col("n").alias("place"),
        F.lit("quality").alias("source"),
        name.alias("id"),
        F.to_json(payload, _JSON).alias("payload"),
        cut.alias("trimmed"),
    )


def schema_lists(schema: DataFrame) -> DataFrame:
    """Added and removed columns of each run, sorted; as many as a header has."""

    def listed(change: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("change") == change, F.col("column"))))

    return schema.groupBy("run_id").agg(listed("added").alias("added"), listed("removed").alias("removed"))


def schema_evidence(schema: DataFrame) -> DataFrame:
    """One entry, always ``C1``, for each run whose columns changed."""
    lists = schema_lists(schema)
    payload = F.struct(
        F.lit("C1").alias("id"),
        F.lit("schema").alias("kind"),
        bounded_list(F.col("added")).alias("added"),
        bounded_list(F.col("removed")).alias("removed"),
    )
    return lists.select(
        "run_id",
        F.lit(MAX_FINDINGS + 1).alias("place"),
        F.lit("schema").alias("source"),
        F.lit("C1").alias("id"),
        F.to_json(payload, _JSON).alias("payload"),
        (list_is_cut(F.col("added")) | list_is_cut(F.col("removed"))).alias("trimmed"),
    )


def _change_entries(results: RunResults) -> DataFrame:
    first = _first(results.changes, [F.col("key")])
    shifted = results.schema.select("run_id").distinct().withColumn("shift", F.lit(1))
    joined = first.join(shifted, "run_id", "left")
    number = F.col("n") + F.coalesce("shift", F.lit(0))
    name = F.concat(F.lit("C"), number.cast("string"))
    payload = F.struct(
        "kind",
        bounded_text(F.col("key")).alias("key"),
        bounded_map(F.col("before")).alias("before"),
        bounded_map(F.col("after")).alias("after"),
        bounded_list(F.col("fields")).alias("fields"),
        name.alias("id"),
    )
    cut = (
        text_is_cut(F.col("key"))
        | map_is_cut(F.col("before"))
        | map_is_cut(F.col("after"))
        | list_is_cut(F.col("fields"))
    )
    return joined.select(
        "run_id",
        (F.col("n") + MAX_FINDINGS + 1).alias("place"),
        F.lit("change").alias("source"),
        name.alias("id"),
        F.to_json(payload, _JSON).alias("payload"),
        cut.alias("trimmed"),
    )


def evidence_ids(results: RunResults) -> DataFrame:
    """Candidate entries of every run in order of ``place``. Numbers advance
    whether or not an entry later fits."""
    entries = _quality_entries(results).unionByName(schema_evidence(results.schema))
    return entries.unionByName(_change_entries(results)).select(*_ENTRY)


# --- budget --------------------------------------------------------------------


def _run_frame(results: RunResults) -> DataFrame:
    """One row per run with its totals and the size of the document around the
    entries, counters at zero."""
    quality = results.quality_summary.select(
        "run_id",
        F.struct("rows", "issues", "affected_rows", "reported_findings").alias("quality_summary"),
    )
    changes = results.change_summary.select(
        "run_id",
        F.struct(
            "before_rows", "after_rows", "added", "removed", "changed", "unchanged",
            "total_changes", "reported_findings",
        ).alias("change_summary"),
    )
    runs = quality.join(changes, "run_id", "full_outer")
    available = {
        "quality": F.coalesce("quality_summary.reported_findings", F.lit(0).cast("bigint")),
        "change": F.coalesce("change_summary.reported_findings", F.lit(0).cast("bigint")),
    }
    frame = F.struct(
        "quality_summary",
        "change_summary",
        F.array().cast("array<string>").alias("evidence"),
        F.struct(
            F.lit(False).alias("applied"),
            F.lit(MAX_FINDINGS).alias("max_findings_per_source"),
            F.lit(MAX_CHARACTERS).alias("max_string_characters"),
            F.lit(MAX_ITEMS).alias("max_collection_items"),
            F.lit(MAX_EVIDENCE_BYTES).alias("max_evidence_bytes"),
            available["quality"].alias("quality_available_findings"),
            F.lit(0).alias("quality_included_findings"),
            available["change"].alias("change_available_findings"),
            F.lit(0).alias("change_included_findings"),
            F.lit(False).alias("schema_evidence_included"),
        ).alias("truncation"),
    )
    return runs.select(
        "run_id",
        F.coalesce("quality_summary.issues", F.lit(0).cast("bigint")).alias("issues"),
        F.coalesce("change_summary.total_changes", F.lit(0).cast("bigint")).alias("total_changes"),
        available["quality"].alias("quality_available"),
        available["change"].alias("change_available"),
        F.octet_length(F.to_json(frame, _JSON)).alias("frame_bytes"),
    )


def _fit(sizes: Column, frame_bytes: Column) -> Column:
    """Go through the entries of one run (41 at most) in order and keep each that
    still fits; one that does not is skipped and later ones are tried.

    The document grows by the entry and a comma; its counters widen too.
    """
    start = F.struct(
        frame_bytes.cast("bigint").alias("bytes"),
        F.lit(0).alias("quality"),
        F.lit(0).alias("change"),
        F.lit(0).alias("schema"),
        F.array().cast("array<int>").alias("kept"),
    )

    def step(state: Column, entry: Column) -> Column:
        comma = F.when(F.size(state["kept"]) > 0, 1).otherwise(0)
        grown = state["bytes"] + entry["size"] + comma
        widened = (
            F.when(state["quality"] > 9, 1).otherwise(0)
            + F.when(state["change"] > 9, 1).otherwise(0)
            - state["schema"]
        )
        fits = grown + widened <= MAX_EVIDENCE_BYTES - RESERVED_BYTES

        def count(source: str) -> Column:
            return (state[source] + F.when(entry["source"] == source, 1).otherwise(0)).alias(source)

        added = F.struct(
            grown.alias("bytes"),
            count("quality"),
            count("change"),
            count("schema"),
            F.array_append(state["kept"], entry["place"]).alias("kept"),
        )
        return F.when(fits, added).otherwise(state)

    return F.aggregate(sizes, start, step)


def _fitted(results: RunResults, entries: DataFrame) -> DataFrame:
    sized = F.struct("place", "source", F.octet_length("payload").alias("size"))
    per_run = entries.groupBy("run_id").agg(
        F.array_sort(F.collect_list(sized)).alias("sizes"), F.bool_or("trimmed").alias("trimmed")
    )
    runs = _run_frame(results).join(per_run, "run_id", "left")
    none = F.array().cast("array<struct<place:int,source:string,size:int>>")
    fit = _fit(F.coalesce("sizes", none), F.col("frame_bytes"))
    return runs.select("*", fit.alias("fit"))


def evidence_budget(results: RunResults) -> DataFrame:
    """The entries of each run that fit its byte budget.

    The candidates, 41 a run at most, are written once: the budget and the
    entries it keeps are both read from them.
    """
    entries = written(evidence_ids(results), "evidence")
    kept = _fitted(results, entries).select("run_id", F.explode("fit.kept").alias("place"))
    return entries.join(kept, ["run_id", "place"])


def truncation_metadata(results: RunResults) -> DataFrame:
    """What was left out of each run's evidence."""
    entries = written(evidence_ids(results), "evidence")
    fitted = _fitted(results, entries)
    offered = F.size(F.coalesce("sizes", F.array().cast("array<struct<place:int,source:string,size:int>>")))
    has_schema = F.coalesce(F.exists("sizes", lambda e: e["source"] == "schema"), F.lit(False))
    quality = F.col("fit.quality").cast("bigint")
    change = F.col("fit.change").cast("bigint")
    schema_in = F.col("fit.schema") > 0
    applied = (
        F.coalesce("trimmed", F.lit(False))
        | (offered > F.size("fit.kept"))
        | (F.col("issues") > quality)
        | (F.col("total_changes") > change)
        | (F.col("quality_available") > quality)
        | (F.col("change_available") > change)
        | (has_schema & ~schema_in)
    )
    return fitted.select(
        "run_id",
        "quality_available",
        quality.alias("quality_included"),
        "change_available",
        change.alias("change_included"),
        schema_in.alias("schema_included"),
        applied.alias("applied"),
        (F.col("fit.bytes") - F.col("frame_bytes")).alias("evidence_bytes"),
    )
