"""Per-column rule checks over a dataset.

A dataset is a DataFrame with a ``record_no`` column (the header is record 1) and
one column per field. Many datasets can be checked in one job: name the columns
that tell them apart in ``by``.

All row-local checks are expressions evaluated in one scan. Uniqueness
needs one shuffle: the first record and the count of every repeated value.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.checks import is_valid
from tabwarden.functions.dataset import header
from tabwarden.functions.hotkeys import join_per_key
from tabwarden.functions.numbers import compare_to_bound, quick_decimal
from tabwarden.functions.text import stripped_or_blank
from tabwarden.operators.rules import ColumnRule, check_rules
from tabwarden.session import written

# Finding codes in report order, and their messages.
CODES = ("missing_column", "required", "type", "min", "max", "allowed", "duplicate")
MESSAGES = {
    "missing_column": "Configured column is missing from the CSV header.",
    "required": "A nonblank value is required.",
    "type": "Expected a valid {} value.",
    "min": "Value must be at least {}.",
    "max": "Value must be at most {}.",
    "allowed": "Value is not in the configured allowed list.",
    "duplicate": "Duplicate value; first seen at record {}.",
}

FINDING_COLUMNS = ("row", "column", "code", "message", "value")
ORDER_COLUMNS = ("col_idx", "code_idx")
_FINDING = (
    "struct<column:string,code:string,message:string,value:string,col_idx:int,code_idx:int>"
)

#: Repeated values are broadcast only below both of these sizes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class ValidationResult:
    """``findings`` is capped and ordered; ``all_findings`` holds every one."""

    summary: DataFrame
    findings: DataFrame
    all_findings: DataFrame


def _value_name(rule: ColumnRule) -> str:
    return f"__v{rule.position}"


def _valid_name(rule: ColumnRule) -> str:
    return f"__ok{rule.position}"


def _quick_name(rule: ColumnRule) -> str:
    return f"__n{rule.position}"


@dataclass(frozen=True)
class _Check:
    """One row-local check: ``failed`` is true, false or NULL (not applicable)."""

    rule: ColumnRule
    code: str
    failed: Column
    message: Column

    @property
    def count(self) -> Column:
        return F.when(self.failed, 1).otherwise(0)

    @property
    def finding(self) -> Column:
        return F.when(
            self.failed,
            F.struct(
                F.lit(self.rule.column).alias("column"),
                F.lit(self.code).alias("code"),
                self.message.alias("message"),
                F.coalesce(F.col(f"`{self.rule.column}`"), F.lit("")).alias("value"),
                F.lit(self.rule.position).alias("col_idx"),
                F.lit(CODES.index(self.code)).alias("code_idx"),
            ),
        )


@dataclass(frozen=True)
class _Plan:
    """The frames the totals and the findings are both built from."""

    local: DataFrame
    checks: list[_Check]
    later: DataFrame | None
    missing: DataFrame | None


def _row_checks(rule: ColumnRule, codes: Collection[str]) -> list[_Check]:
    value = F.col(_value_name(rule))
    present = value != ""
    valid = F.col(_valid_name(rule))
    checks: list[_Check] = []
    if rule.required and "required" in codes:
        checks.append(_Check(rule, "required", ~present, F.lit(MESSAGES["required"])))
    if rule.type != "string" and "type" in codes:
        message = MESSAGES["type"].format(rule.type)
        checks.append(_Check(rule, "type", present & ~valid, F.lit(message)))
    for name, bound, side in (("min", rule.min, -1), ("max", rule.max, 1)):
        if bound is not None and name in codes:
            # The guard keeps the comparison off text that is not a number.
            compared = compare_to_bound(value, bound, F.col(_quick_name(rule)))
            outside = F.when(present & valid, compared == side)
            checks.append(_Check(rule, name, outside, F.lit(MESSAGES[name].format(bound))))
    if rule.allowed is not None and "allowed" in codes:
        listed = value.isin(*rule.allowed)
        checks.append(_Check(rule, "allowed", present & ~listed, F.lit(MESSAGES["allowed"])))
    return checks


def _prepared(ds: DataFrame, rules: Sequence[ColumnRule], by: Sequence[str]) -> DataFrame:
    """Only the ruled columns, each beside its stripped value and type test."""
    names = list(dict.fromkeys(rule.column for rule in rules))
    cells = [F.col(f"`{name}`").cast("string").alias(name) for name in names]
    stripped = [
        stripped_or_blank(F.col(f"`{rule.column}`").cast("string")).alias(_value_name(rule))
        for rule in rules
    ]
    numbers = [
        quick_decimal(F.col(_value_name(rule))).alias(_quick_name(rule))
        for rule in rules
        if rule.type in ("integer", "number")
    ]
    tests = [
        is_valid(
            F.col(_value_name(rule)),
            rule.type,
            F.col(_quick_name(rule)) if rule.type == "number" else None,
        ).alias(_valid_name(rule))
        for rule in rules
        if rule.type != "string"
    ]
    values = ds.select(*by, "record_no", *cells, *stripped)
    return values.select("*", *numbers).select("*", *tests)


def _cells(
    prepared: DataFrame, rules: Sequence[ColumnRule], by: Sequence[str], *more: Column
) -> DataFrame:
    """Long form of the nonblank cells of unique columns."""
    entries = F.array(
        *[
            F.struct(
                F.lit(rule.position).alias("col_idx"),
                F.lit(rule.column).alias("column"),
                F.col(_value_name(rule)).alias("v"),
                F.coalesce(F.col(f"`{rule.column}`"), F.lit("")).alias("value"),
            )
            for rule in rules
        ]
    )
    long = prepared.select(*by, "record_no", *more, F.explode(entries).alias("cell"))
    return long.filter(F.col("cell.v") != "").select(
        *[name for name in long.columns if name != "cell"], "cell.*"
    )


def repeated_values(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First record and count of every value that occurs more than once.

    The aggregation combines before the shuffle, so a value shared by very many
    records costs no more than any other.
    """
    stats = cells.groupBy(*by, "col_idx", "v").agg(
        F.min("record_no").alias("first_record"), F.count(F.lit(1)).alias("occurrences")
    )
    return stats.filter("occurrences > 1")


def _fits_broadcast(repeats: DataFrame) -> bool:
    size = repeats.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0)).alias("b")
    ).first()
    return size.n <= BROADCAST_ROWS and size.b <= BROADCAST_BYTES


def _first_name(rule: ColumnRule) -> str:
    return f"__first{rule.position}"


def _duplicate_message() -> tuple[str, str]:
    lead, tail = MESSAGES["duplicate"].split("{}")
    return lead, tail


def _with_first_records(
    prepared: DataFrame, repeats: DataFrame, rules: Sequence[ColumnRule], by: Sequence[str]
) -> DataFrame:
    """Beside each unique cell, the first record of its value if it repeats.

    The repeats are of checked size, so each column looks them up in its own
    broadcast and the whole check stays in the scan.
    """
    for rule in rules:
        mine = repeats.filter(F.col("col_idx") == rule.position).select(
            *[F.col(name).alias(f"__by{n}") for n, name in enumerate(by)],
            F.col("v").alias("__v"),
            F.col("first_record").alias(_first_name(rule)),
        )
        same = F.col(_value_name(rule)) == F.col("__v")
        for n, name in enumerate(by):
            same = same & F.col(name).eqNullSafe(F.col(f"__by{n}"))
        helpers = [f"__by{n}" for n in range(len(by))]
        prepared = prepared.join(F.broadcast(mine), same, "left").drop("__v", *helpers)
    return prepared


def _duplicate_check(rule: ColumnRule) -> _Check:
    first = F.col(_first_name(rule))
    lead, tail = _duplicate_message()
    message = F.concat(F.lit(lead), first.cast("string"), F.lit(tail))
    return _Check(rule, "duplicate", first < F.col("record_no"), message)


def _later_occurrences(
    local: DataFrame, repeats: DataFrame, rules: Sequence[ColumnRule], by: Sequence[str]
) -> DataFrame:
    """Every occurrence after the first, with the record of the first, where there
    are too many repeated values to broadcast."""
    cells = _cells(local, rules, by, (F.col("__issues") == 0).alias("clean"))
    keys = [*by, "col_idx", "v"]
    joined = join_per_key(cells, repeats, keys, weight="occurrences", spread_by="record_no", null_safe=by)
    return joined.filter(F.col("first_record") < F.col("record_no"))


def _duplicate_findings(later: DataFrame, by: Sequence[str]) -> DataFrame:
    lead, tail = _duplicate_message()
    message = F.concat(F.lit(lead), F.col("first_record").cast("string"), F.lit(tail))
    return later.select(
        *by,
        F.col("record_no").alias("row"),
        "column",
        F.lit("duplicate").alias("code"),
        message.alias("message"),
        "value",
        "col_idx",
        F.lit(CODES.index("duplicate")).alias("code_idx"),
    )


def _missing_findings(
    ds: DataFrame, missing: Sequence[ColumnRule], by: Sequence[str]
) -> DataFrame:
    entries = [
        (rule.column, "missing_column", MESSAGES["missing_column"], "", rule.position, 0)
        for rule in missing
    ]
    schema = "column string, code string, message string, value string, col_idx int, code_idx int"
    rows = ds.sparkSession.createDataFrame(entries, schema)
    if by:
        literal = F.array(
            *[
                F.struct(*[F.lit(v).alias(n) for n, v in zip(rows.columns, entry, strict=True)])
                for entry in entries
            ]
        )
        groups = ds.select(*by).distinct()
        rows = groups.select(*by, F.explode(literal).alias("entry")).select(*by, "entry.*")
    return rows.select(
        *by, F.lit(None).cast("bigint").alias("row"), *FINDING_COLUMNS[1:], *ORDER_COLUMNS
    )


def split_rules(ds: DataFrame, rules: Any) -> tuple[list[ColumnRule], list[ColumnRule]]:
    """The rules of columns that ``ds`` has, and those of columns that it lacks."""
    checked = rules if _is_checked(rules) else check_rules(rules)
    names = set(header(ds))
    present = [rule for rule in checked if rule.column in names]
    absent = [rule for rule in checked if rule.column not in names]
    return present, absent


def _is_checked(rules: Any) -> bool:
    return isinstance(rules, (list, tuple)) and all(isinstance(r, ColumnRule) for r in rules)


def _plan(ds: DataFrame, rules: Any, codes: Collection[str], by: Sequence[str]) -> _Plan:
    present, absent = split_rules(ds, rules)
    checks = [check for rule in present for check in _row_checks(rule, codes)]
    prepared = _prepared(ds, present, by)
    unique = [rule for rule in present if rule.unique] if "duplicate" in codes else []
    repeats, inline = None, False
    if unique:
        repeats = written(repeated_values(_cells(prepared, unique, by), by), "repeats")
        inline = _fits_broadcast(repeats)
    if inline:
        prepared = _with_first_records(prepared, repeats, unique, by)
        checks += [_duplicate_check(rule) for rule in unique]
    issues = sum((check.count for check in checks), F.lit(0))
    local = prepared.withColumn("__issues", issues)
    later = None
    if unique and not inline:
        later = _later_occurrences(local, repeats, unique, by)
    missing = None
    if absent and "missing_column" in codes:
        missing = _missing_findings(ds, absent, by)
    return _Plan(local, checks, later, missing)


def _findings_of(plan: _Plan, by: Sequence[str]) -> DataFrame:
    columns = [*by, *FINDING_COLUMNS, *ORDER_COLUMNS]
    slots = [check.finding for check in plan.checks] or [F.lit(None).cast(_FINDING)]
    exploded = plan.local.select(
        *by, F.col("record_no").alias("row"), F.explode(F.array(*slots)).alias("finding")
    )
    found = exploded.filter(F.col("finding").isNotNull())
    result = found.select(*by, "row", "finding.*").select(*columns)
    if plan.later is not None:
        result = result.unionByName(_duplicate_findings(plan.later, by).select(*columns))
    if plan.missing is not None:
        result = result.unionByName(plan.missing.select(*columns))
    return result


def _summary_of(plan: _Plan, max_findings: int, by: Sequence[str]) -> DataFrame:
    """Exact totals. Row-local checks are counted in the scan, without a shuffle;
    only otherwise clean records with a repeated value are told apart by record.
    """
    zero = F.lit(0).cast("bigint")
    size = F.col("__issues")
    counts = plan.local.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(size), zero).alias("issues"),
        F.count_if(size > 0).alias("affected_rows"),
    )
    if plan.later is not None:
        per_record = plan.later.groupBy(*by, "record_no").agg(
            F.count(F.lit(1)).alias("n"), F.bool_and("clean").alias("clean")
        )
        counts = counts.unionByName(
            per_record.groupBy(*by).agg(
                zero.alias("rows"),
                F.coalesce(F.sum("n"), zero).alias("issues"),
                F.count_if("clean").alias("affected_rows"),
            )
        )
    if plan.missing is not None:
        counts = counts.unionByName(
            plan.missing.groupBy(*by).agg(
                zero.alias("rows"),
                F.count(F.lit(1)).alias("issues"),
                zero.alias("affected_rows"),
            )
        )
    totals = counts.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("issues").alias("issues"),
        F.sum("affected_rows").alias("affected_rows"),
    )
    return totals.select(
        *by,
        "rows",
        "issues",
        "affected_rows",
        F.least("issues", F.lit(max_findings).cast("bigint")).alias("reported_findings"),
        validation_status(F.col("issues")).alias("status"),
    )


def all_findings(
    ds: DataFrame,
    rules: Any,
    codes: Collection[str] = CODES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every finding, unordered, with ``(col_idx, code_idx)`` to sort by."""
    return _findings_of(_plan(ds, rules, codes, by), by)


def validation_summary(
    ds: DataFrame, rules: Any, max_findings: int = 500, by: Sequence[str] = ()
) -> DataFrame:
    """Exact totals and status per dataset, whatever the cap."""
    return _summary_of(_plan(ds, rules, CODES, by), max_findings, by)


def in_report_order(findings: DataFrame) -> DataFrame:
    """Missing columns first, then by record, rule position and check."""
    return findings.orderBy(F.asc_nulls_first("row"), "col_idx", "code_idx")


def findings_cap(findings: DataFrame, max_findings: int = 500) -> DataFrame:
    """The first findings in report order, numbered from 1 in ``seq``.

    The rows numbered are the capped ones, so the unpartitioned numbering never
    sees more than ``max_findings`` rows.
    """
    if type(max_findings) is not int or max_findings < 0:
        raise ValueError("max_findings must be a nonnegative whole number")
    capped = in_report_order(findings).limit(max_findings)
    entry = F.struct(
        F.col("row").isNotNull().alias("located"),
        F.col("row").alias("row"),
        "col_idx",
        "code_idx",
        "column",
        "code",
        "message",
        "value",
    )
    ordered = capped.agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    numbered = ordered.select(F.posexplode("entries").alias("place", "entry"))
    return numbered.select(
        (F.col("place") + 1).cast("bigint").alias("seq"),
        *[F.col(f"entry.{name}").alias(name) for name in FINDING_COLUMNS],
    )


def validation_status(issues: Column) -> Column:
    return F.when(issues > 0, F.lit("fail")).otherwise(F.lit("pass"))


def cap_notice(summary: DataFrame, total: str = "issues") -> DataFrame:
    """How many findings the report leaves out, and the notice text if any."""
    shown = F.col("reported_findings")
    omitted = F.greatest(F.col(total) - shown, F.lit(0))
    notice = F.when(
        omitted > 0,
        F.format_string(
            "Showing %s of %s findings.", F.format_number(shown, 0), F.format_number(total, 0)
        ),
    )
    return summary.select(
        "*", omitted.cast("bigint").alias("omitted"), F.coalesce(notice, F.lit("")).alias("notice")
    )


def validate(ds: DataFrame, rules: Any, max_findings: int = 500) -> ValidationResult:
    """Check one dataset against a rule document."""
    checked = rules if _is_checked(rules) else check_rules(rules)
    plan = _plan(ds, checked, CODES, ())
    findings = _findings_of(plan, ())
    return ValidationResult(
        summary=_summary_of(plan, max_findings, ()),
        findings=findings_cap(findings, max_findings),
        all_findings=findings,
    )


# --- single checks -------------------------------------------------------------


def _single(ds: DataFrame, code: str, rule: ColumnRule, by: Sequence[str] = ()) -> DataFrame:
    return all_findings(ds, [rule], {code}, by).select(*by, *FINDING_COLUMNS)


def missing_column(ds: DataFrame, *columns: str) -> DataFrame:
    rules = [ColumnRule(place, name) for place, name in enumerate(columns)]
    return all_findings(ds, rules, {"missing_column"}).select(*FINDING_COLUMNS)


def required(ds: DataFrame, column: str) -> DataFrame:
    return _single(ds, "required", ColumnRule(0, column, required=True))


def type_check(ds: DataFrame, column: str, column_type: str) -> DataFrame:
    return _single(ds, "type", ColumnRule(0, column, type=column_type))


def min_bound(ds: DataFrame, column: str, bound: Any, column_type: str = "number") -> DataFrame:
    document = {"version": 1, "columns": {column: {"type": column_type, "min": bound}}}
    return _single(ds, "min", check_rules(document)[0])


def max_bound(ds: DataFrame, column: str, bound: Any, column_type: str = "number") -> DataFrame:
    document = {"version": 1, "columns": {column: {"type": column_type, "max": bound}}}
    return _single(ds, "max", check_rules(document)[0])


def allowed(ds: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return _single(ds, "allowed", ColumnRule(0, column, allowed=tuple(values)))


def allowed_in(ds: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``allowed`` with the list as the first column of a table of any size.

    Values are compared stripped; blank and NULL cells and list entries count for
    nothing, so an empty list allows no value. A list of measured small size is
    broadcast to the rows. Beyond it, the distinct values of the column, combined
    before the shuffle so that one on very many rows moves once a task, are looked up
    in the list, and only what is not listed goes back to the rows.
    """
    name = values.columns[0]
    listed = values.select(stripped_or_blank(F.col(f"`{name}`").cast("string")).alias("v")).filter("v <> ''").distinct()
    listed = written(listed, "allowed-values")
    cell = F.col(f"`{column}`").cast("string")
    cells = ds.select(F.col("record_no").alias("row"), cell.alias("value"), stripped_or_blank(cell).alias("v")).filter("v <> ''")
    if _fits_broadcast(listed):
        found = cells.join(F.broadcast(listed), "v", "left_anti")
    else:
        counted = cells.groupBy("v").agg(F.count(F.lit(1)).alias("occurrences"))
        unlisted = written(counted.join(listed, "v", "left_anti"), "unlisted-values")
        if _fits_broadcast(unlisted):
            found = cells.join(F.broadcast(unlisted), "v", "left_semi")
        else:
            joined = join_per_key(cells, unlisted, ["v"], weight="occurrences", spread_by="row")
            found = joined.filter("occurrences is not null")
    return found.select(
        "row",
        F.lit(column).alias("column"),
        F.lit("allowed").alias("code"),
        F.lit(MESSAGES["allowed"]).alias("message"),
        "value",
    )


def unique(ds: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return _single(ds, "duplicate", ColumnRule(0, column, unique=True), by)
