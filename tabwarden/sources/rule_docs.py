"""Rule documents in bulk: exploded to rows, with findings for bad ones.

The driver-side form of the same checks is ``operators.rules.check_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.checks import COLUMN_TYPES
from tabwarden.functions.numbers import compare_numbers
from tabwarden.functions.staging import evaluated
from tabwarden.functions.text import strip
from tabwarden.operators.rules import DOCUMENT_KEYS, RULE_KEYS


def without_mark(text: Column) -> Column:
    """Text without a leading byte order mark."""
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2_000_000_000)).otherwise(text)


def strict_json(text: Column) -> Column:
    """JSON as a variant; NULL for anything malformed.

    The parser ignores text after a complete value, so the document is wrapped in
    an array with an end mark: only a document that ends where it should yields
    exactly two elements. The mark is the digest of the document, which the document
    cannot hold. Repeated keys and NaN are already refused.
    """
    body = without_mark(text)
    end = F.sha2(body, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), end, F.lit('"]')))
    marked = F.try_variant_get(wrapped, "$[1]", "string") == end
    longer = F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return F.when(marked & longer, F.try_variant_get(wrapped, "$[0]", "variant"))


# Type names a variant reports, and the JSON types they stand for.
_KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
}


def json_kind(value: Column) -> Column:
    """JSON type of a variant: object, array, string, boolean, number or null."""
    names = F.create_map(*[F.lit(text) for pair in _KINDS.items() for text in pair])
    return names[F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)]


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def rule_catalog(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rules, lint)`` from rows ``(rule_set, doc)``.

    ``rules`` has one row per column of every document, in document order;
    ``lint`` has one row per problem, ``(rule_set, column, code)``.
    """
    plain = docs.select("rule_set", without_mark(F.col("doc")).alias("doc"))
    parsed = evaluated(plain, "rule_set", "doc", strict_json(F.col("doc")).alias("v"))
    kind = json_kind(F.col("v"))
    keys = F.when(kind == "object", F.json_object_keys("doc"))
    version = _get(F.col("v"), "$.version")
    whole = F.schema_of_variant(version) == "BIGINT"
    is_one = F.coalesce(whole & (_get(F.col("v"), "$.version", "string") == "1"), F.lit(False))
    columns = _get(F.col("v"), "$.columns")
    expected = F.array(*[F.lit(key) for key in sorted(DOCUMENT_KEYS)])
    code = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(kind != "object", "not_an_object")
        .when(F.array_sort(keys) != expected, "wrong_keys")
        .when(~is_one, "bad_version")
        .when(json_kind(columns) != "object", "columns_not_an_object")
    )
    judged = evaluated(parsed, "rule_set", "doc", "v", code.alias("code"))
    bad_documents = judged.filter(F.col("code").isNotNull()).select(
        "rule_set", F.lit("").alias("column"), "code"
    )
    names = F.json_object_keys(F.get_json_object("doc", "$.columns"))
    # Keys of a parsed object keep document order here; a variant sorts them.
    listed = judged.filter(F.col("code").isNull()).select(
        "rule_set", _get(F.col("v"), "$.columns").alias("columns"), F.posexplode(names).alias("col_idx", "column")
    )
    rules_map = F.try_variant_get("columns", "$", "map<string,variant>")
    rule = F.element_at(rules_map, F.col("column")).alias("rule")
    each = evaluated(listed, "rule_set", "col_idx", "column", rule)
    each = _with_rule_code(each)
    lint = bad_documents.unionByName(
        each.filter(F.col("code").isNotNull()).select("rule_set", "column", "code")
    )
    # One bad rule spoils its whole document, as it does for the driver-side check.
    spoiled = lint.select("rule_set").distinct()
    rule = F.col("rule")
    flag = F.lit(False)
    rules = each.filter(F.col("code").isNull()).select(
        "rule_set",
        "col_idx",
        "column",
        F.coalesce(_get(rule, "$.required", "boolean"), flag).alias("required"),
        F.coalesce(_get(rule, "$.unique", "boolean"), flag).alias("unique"),
        F.coalesce(_get(rule, "$.type", "string"), F.lit("string")).alias("type"),
        _get(rule, "$.min", "string").alias("min"),
        _get(rule, "$.max", "string").alias("max"),
        _get(rule, "$.allowed", "array<string>").alias("allowed"),
    )
    return rules.join(spoiled, "rule_set", "left_anti"), lint


def _with_rule_code(each: DataFrame) -> DataFrame:
    """Add the first problem of each column's rule, in steps that parse once."""
    rule = F.col("rule")
    kinds = [
        F.coalesce(json_kind(_get(rule, f"$.{name}")), F.lit("null")).alias(f"{name}_kind")
        for name in RULE_KEYS
    ]
    parts = each.select(
        "*",
        json_kind(rule).alias("rule_kind"),
        F.json_object_keys(F.to_json(rule)).alias("keys"),
        *kinds,
    ).select(
        "*",
        F.when(F.array_contains("keys", "type"), _get(rule, "$.type", "string"))
        .otherwise("string")
        .alias("type_name"),
        F.when(F.col("allowed_kind") == "array", _get(rule, "$.allowed", "array<variant>")).alias(
            "listed"
        ),
    )
    known = F.array(*[F.lit(key) for key in RULE_KEYS])

    def given(name: str) -> Column:
        return F.array_contains("keys", name)

    def wrong(name: str, kind: str) -> Column:
        return given(name) & (F.col(f"{name}_kind") != kind)

    crossed = compare_numbers(_get(rule, "$.min", "string"), _get(rule, "$.max", "string")) > 0
    texts = F.forall("listed", lambda item: json_kind(item) == "string")
    usable = F.coalesce((F.size("listed") > 0) & texts, F.lit(False))
    code = (
        F.when(strip(F.col("column")) == "", "blank_column")
        .when(F.col("rule_kind") != "object", "rule_not_an_object")
        .when(F.size(F.array_except("keys", known)) > 0, "unknown_rule_key")
        .when(wrong("required", "boolean"), "required_not_boolean")
        .when(wrong("unique", "boolean"), "unique_not_boolean")
        .when(wrong("type", "string") | ~F.col("type_name").isin(*COLUMN_TYPES), "bad_type")
        .when(
            (given("min") | given("max")) & ~F.col("type_name").isin("integer", "number"),
            "bound_needs_number",
        )
        .when(wrong("min", "number"), "bad_min")
        .when(wrong("max", "number"), "bad_max")
        .when(given("min") & given("max") & crossed, "min_exceeds_max")
        .when(given("allowed") & ~usable, "bad_allowed")
    )
    return evaluated(parts, "rule_set", "col_idx", "column", "rule", code.alias("code"))
