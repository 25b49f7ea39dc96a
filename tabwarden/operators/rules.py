"""Rule documents as checked driver-side configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from tabwarden.functions.checks import COLUMN_TYPES

# The keys a rule document and one column's rule may have.
DOCUMENT_KEYS = ("version", "columns")
RULE_KEYS = ("required", "unique", "type", "min", "max", "allowed")


class RuleError(ValueError):
    """A rule document that cannot be applied."""


@dataclass(frozen=True)
class ColumnRule:
    """The checks of one column; ``position`` is its place in the document."""

    position: int
    column: str
    required: bool = False
    unique: bool = False
    type: str = "string"
    min: Decimal | None = None
    max: Decimal | None = None
    allowed: tuple[str, ...] | None = None


def _pairs_once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    names = [name for name, _ in pairs]
    repeated = {name for name in names if names.count(name) > 1}
    if repeated:
        raise RuleError(f"duplicate key {min(repeated)!r}")
    return dict(pairs)


def _no_constant(text: str) -> None:
    raise RuleError(f"non-finite number {text}")


def parse_rules(text: str) -> dict[str, Any]:
    """Strict JSON: no repeated key at any level, no NaN or Infinity."""
    try:
        return json.loads(
            text.removeprefix("\ufeff"),
            object_pairs_hook=_pairs_once,
            parse_float=Decimal,
            parse_constant=_no_constant,
        )
    except (json.JSONDecodeError, InvalidOperation, RecursionError) as error:
        raise RuleError(f"invalid rule document: {error}") from error


def _bound(column: str, name: str, rule: Mapping[str, Any]) -> Decimal | None:
    if name not in rule:
        return None
    value = rule[name]
    numeric = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    number = Decimal(str(value)) if numeric else Decimal("nan")
    if not number.is_finite():
        raise RuleError(f"{column!r}.{name}: a finite number is needed")
    return number


def _column_rule(position: int, column: Any, rule: Any) -> ColumnRule:
    if not isinstance(column, str) or not column.strip():
        raise RuleError("column names must be nonblank text")
    if not isinstance(rule, Mapping):
        raise RuleError(f"{column!r}: an object is needed")
    extra = [key for key in rule if key not in RULE_KEYS]
    if extra:
        raise RuleError(f"{column!r}: unknown rule key {extra[0]!r}")
    for flag in ("required", "unique"):
        if not isinstance(rule.get(flag, False), bool):
            raise RuleError(f"{column!r}.{flag}: true or false is needed")
    kind = rule.get("type", "string")
    if not isinstance(kind, str) or kind not in COLUMN_TYPES:
        raise RuleError(f"{column!r}.type: one of {', '.join(COLUMN_TYPES)} is needed")
    if ("min" in rule or "max" in rule) and kind not in ("integer", "number"):
        raise RuleError(f"{column!r}: bounds need type integer or number")
    low, high = _bound(column, "min", rule), _bound(column, "max", rule)
    if low is not None and high is not None and low > high:
        raise RuleError(f"{column!r}: min exceeds max")
    allowed = None
    if "allowed" in rule:
        values = rule["allowed"]
        texts = isinstance(values, (list, tuple)) and all(isinstance(v, str) for v in values)
        if not texts or not values:
            raise RuleError(f"{column!r}.allowed: a nonempty list of texts is needed")
        allowed = tuple(values)
    return ColumnRule(
        position=position,
        column=column,
        required=rule.get("required", False),
        unique=rule.get("unique", False),
        type=kind,
        min=low,
        max=high,
        allowed=allowed,
    )


def check_rules(rules: Any) -> list[ColumnRule]:
    """Turn a rule document (text or parsed) into column rules in document order."""
    if isinstance(rules, str):
        rules = parse_rules(rules)
    if not isinstance(rules, Mapping) or sorted(rules) != sorted(DOCUMENT_KEYS):
        raise RuleError("a rule document has exactly the keys version and columns")
    if type(rules["version"]) is not int or rules["version"] != 1:
        raise RuleError("version must be the whole number 1")
    columns = rules["columns"]
    if not isinstance(columns, Mapping):
        raise RuleError("columns must map column names to rules")
    return [_column_rule(place, name, rule) for place, (name, rule) in enumerate(columns.items())]
