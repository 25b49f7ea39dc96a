"""Keyed comparison of two snapshots.

Keys match after stripping, values match exactly. Keys must be nonblank and
unique on each side: :func:`compare` checks that first, so the join that follows
never meets a hot key.

:func:`compared` answers everything from one full outer join of keys and row digests.
Records themselves move only if they were added, removed or changed, and are written
once for all results. The single functions below each plan their own join, over whole
records; ``added_rows`` and ``removed_rows`` need only the other side's keys.

Many pairs of snapshots can be compared in one job: name the columns that tell
them apart in ``by``; they join together with the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.dataset import header
from tabwarden.functions.text import stripped_or_blank
from tabwarden.session import written

KINDS = ("added", "removed", "changed", "unchanged")
_KEY = "__key"


class KeyContractError(ValueError):
    """The key column cannot identify records."""


@dataclass(frozen=True)
class DiffResult:
    summary: DataFrame
    schema_diff: DataFrame
    findings: DataFrame
    cells: DataFrame


@dataclass(frozen=True)
class Shape:
    """Which fields each side has, apart from key, grouping and record number."""

    key: str
    by: tuple[str, ...]
    before: tuple[str, ...]
    after: tuple[str, ...]
    before_header: tuple[str, ...]
    after_header: tuple[str, ...]

    @property
    def shared(self) -> list[str]:
        return sorted(set(self.before) & set(self.after))


def _ticked(name: str) -> str:
    return f"`{name}`"


def _shape(before: DataFrame, after: DataFrame, key: str, by: Sequence[str]) -> Shape:
    headers = [tuple(n for n in header(df) if n not in by) for df in (before, after)]
    fields = [tuple(name for name in names if name != key) for names in headers]
    return Shape(key, tuple(by), *fields, *headers)


def _matched(text: Column) -> Column:
    """NULL-safe form of a key: a NULL key is a blank key."""
    return stripped_or_blank(text.cast("string"))


# --- contract of the key -------------------------------------------------------


def key_missing(before: DataFrame, after: DataFrame, key: str) -> list[str]:
    """What is wrong with the key's name; empty if nothing."""
    if not isinstance(key, str) or not key.strip():
        return ["the comparison key must be a nonblank column name"]
    sides = (("before", before), ("after", after))
    return [
        f"{side}: key column {key!r} is missing" for side, df in sides if key not in df.columns
    ]


def key_blank(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per side, how many keys are blank and the first record with one."""
    sides = [_keys(before, key, "before"), _keys(after, key, "after")]
    blank = F.when(F.col(_KEY) == "", F.col("record_no"))
    return _per_side(
        sides[0].unionByName(sides[1]).groupBy("side").agg(
            F.count(blank).alias("violations"), F.min(blank).alias("first_record")
        )
    )


def key_duplicate(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per side, how many nonblank keys repeat, and the earliest record that
    repeats a key.

    Keeping two rows per key is pushed below the shuffle, so a key on very many
    records moves two rows per task, not all of them.
    """
    rows = _keys(before, key, "before").unionByName(_keys(after, key, "after"))
    order = Window.partitionBy("side", _KEY).orderBy("record_no")
    nonblank = rows.filter(F.col(_KEY) != "")
    second = nonblank.withColumn("n", F.row_number().over(order)).filter("n <= 2").filter("n = 2")
    found = second.groupBy("side").agg(
        F.count(F.lit(1)).alias("violations"), F.min("record_no").alias("first_record")
    )
    return _per_side(found)


def _keys(df: DataFrame, key: str, side: str) -> DataFrame:
    return df.select(
        F.lit(side).alias("side"), _matched(F.col(_ticked(key))).alias(_KEY), "record_no"
    )


def _per_side(found: DataFrame) -> DataFrame:
    """One row for each side, also where nothing was found."""
    none = found.sparkSession.createDataFrame(
        [("before", 0, None), ("after", 0, None)],
        "side string, violations bigint, first_record bigint",
    )
    return (
        found.unionByName(none)
        .groupBy("side")
        .agg(F.sum("violations").alias("violations"), F.min("first_record").alias("first_record"))
    )


def check_key(before: DataFrame, after: DataFrame, key: str) -> None:
    """Raise unless the key identifies every record of both sides.

    One aggregation over the key columns finds whether anything is wrong; only
    then are the records to name looked for.
    """
    problems = key_missing(before, after, key)
    if problems:
        raise KeyContractError(problems[0])
    _check_keys({"before": before, "after": after}, key)


def check_key_of(ds: DataFrame, key: str, name: str = "snapshot") -> None:
    """Raise unless the key identifies every record of one snapshot."""
    if key not in ds.columns:
        raise KeyContractError(f"{name}: key column {key!r} is missing")
    _check_keys({name: ds}, key)


def _check_keys(sides: dict[str, DataFrame], key: str) -> None:
    rows = None
    for name, df in sides.items():
        side = _keys(df, key, name)
        rows = side if rows is None else rows.unionByName(side)
    blank = F.when(F.col(_KEY) == "", F.col("record_no"))
    counts = rows.groupBy("side", _KEY).agg(F.count(F.lit(1)).alias("n"))
    if counts.filter((F.col("n") > 1) | (F.col(_KEY) == "")).isEmpty():
        return
    # The side read first is named first; within it, the earliest record.
    found = []
    for what, frame in (("blank", rows.groupBy("side").agg(F.min(blank).alias("record"))), ("duplicate", _repeats(rows))):
        for row in frame.filter("record is not null").collect():
            found.append((list(sides).index(row.side), row.record, what, row.side))
    _, record, what, side = min(found)
    raise KeyContractError(f"{side}, record {record}: key {key!r} is {what}")


def _repeats(rows: DataFrame) -> DataFrame:
    """Per side, the earliest record that repeats a nonblank key."""
    order = Window.partitionBy("side", _KEY).orderBy("record_no")
    second = rows.filter(F.col(_KEY) != "").withColumn("n", F.row_number().over(order)).filter("n <= 2").filter("n = 2")
    return second.groupBy("side").agg(F.min("record_no").alias("record"))


# --- schema --------------------------------------------------------------------


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns only one side has, as ``(change, column)``."""
    old, new = set(header(before)), set(header(after))
    rows = [("added", name) for name in sorted(new - old)]
    rows += [("removed", name) for name in sorted(old - new)]
    return before.sparkSession.createDataFrame(rows, "change string, `column` string")


def schema_diff_catalog(before: DataFrame, after: DataFrame) -> DataFrame:
    """Schema changes of many datasets from catalogs of ``(dataset, column)``."""
    keys = ["dataset", "column"]
    old = before.select(*keys).distinct().withColumn("in_before", F.lit(True))
    new = after.select(*keys).distinct().withColumn("in_after", F.lit(True))
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("in_before").isNull(), "added").when(
        F.col("in_after").isNull(), "removed"
    )
    return both.select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


# --- records -------------------------------------------------------------------


def _side(df: DataFrame, shape: Shape, fields: Sequence[str], name: str) -> DataFrame:
    # The key's own spelling comes first, so the struct is never empty.
    image = F.struct(
        F.col(_ticked(shape.key)).alias("__spelling"), *[F.col(_ticked(field)).alias(field) for field in fields]
    )
    return df.select(*shape.by, _matched(F.col(_ticked(shape.key))).alias(_KEY), image.alias(name))


def _joined(before: DataFrame, after: DataFrame, shape: Shape) -> DataFrame:
    """Both sides side by side, as structs that are NULL where a side is absent."""
    old, new = _side(before, shape, shape.before, "old"), _side(after, shape, shape.after, "new")
    return old.join(new, [*shape.by, _KEY], "full_outer")


def _old(field: str) -> Column:
    return F.col("old").getField(field)


def _new(field: str) -> Column:
    return F.col("new").getField(field)


def _differs(field: str) -> Column:
    return ~_old(field).eqNullSafe(_new(field))


def _kind(shape: Shape) -> Column:
    changed = F.lit(False)
    for field in shape.shared:
        changed = changed | _differs(field)
    return (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(changed, "changed")
        .otherwise("unchanged")
    )


def _classified(
    before: DataFrame, after: DataFrame, key: str, by: Sequence[str]
) -> tuple[DataFrame, Shape]:
    shape = _shape(before, after, key, by)
    return _joined(before, after, shape).withColumn("kind", _kind(shape)), shape


def _fields(shape: Shape) -> Column:
    """Names of the fields a finding is about, sorted."""

    def names(fields: Sequence[str]) -> Column:
        return F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")

    changed = F.array(*[F.when(_differs(f), F.lit(f)) for f in shape.shared])
    return (
        F.when(F.col("kind") == "added", names(shape.after))
        .when(F.col("kind") == "removed", names(shape.before))
        .otherwise(F.array_compact(changed.cast("array<string>")))
    )


def diff_classify(
    before: DataFrame, after: DataFrame, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Every key of either side with its kind."""
    rows, _ = _classified(before, after, key, by)
    return rows.select(*by, F.col(_KEY).alias("key"), "kind")


def changed_fields(
    before: DataFrame, after: DataFrame, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Changed records with the sorted names of the fields that differ."""
    rows, shape = _classified(before, after, key, by)
    changed = rows.filter(F.col("kind") == "changed")
    return changed.select(*by, F.col(_KEY).alias("key"), _fields(shape).alias("fields"))


def _only_in(df: DataFrame, other: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    kept = df.select("*", _matched(F.col(_ticked(key))).alias(_KEY))
    keys = other.select(_matched(F.col(_ticked(key))).alias(_KEY))
    names = F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")
    return kept.join(keys, _KEY, "left_anti").select(
        F.col(_KEY).alias("key"), names.alias("fields"), *[F.col(_ticked(f)) for f in fields]
    )


def added_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Records only the later snapshot has. Of the earlier one, only keys move."""
    return _only_in(after, before, key, _shape(before, after, key, ()).after)


def removed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return _only_in(before, after, key, _shape(before, after, key, ()).before)


def unchanged_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of both sides whose shared fields all agree."""
    shape = _shape(before, after, key, ())
    sides = [
        df.select(
            _matched(F.col(_ticked(key))).alias(_KEY),
            F.struct(F.lit(True).alias("__present"), *[F.col(_ticked(f)).alias(f) for f in shape.shared])
            .alias(name),
        )
        for df, name in ((before, "old"), (after, "new"))
    ]
    both = sides[0].join(sides[1], _KEY)
    for field in shape.shared:
        both = both.filter(~_differs(field))
    return both.select(F.col(_KEY).alias("key"))


def _image(side: str, key: str, columns: Sequence[str]) -> Column:
    """The whole record of one side as a map in header order, NULL where the side
    is absent."""
    image = F.col(side)
    names = F.array(*[F.lit(name) for name in columns])
    values = F.array(
        *[
            image.getField("__spelling" if name == key else name).cast("string")
            for name in columns
        ]
    )
    return F.when(image.isNotNull(), F.map_from_arrays(names, values))


def row_images(
    before: DataFrame, after: DataFrame, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Findings with the full record of each side."""
    rows, shape = _classified(before, after, key, by)
    return _images(rows.filter(F.col("kind") != "unchanged"), shape)


def _images(rows: DataFrame, shape: Shape) -> DataFrame:
    return rows.select(
        *shape.by,
        "kind",
        F.col(_KEY).alias("key"),
        _image("old", shape.key, shape.before_header).alias("before"),
        _image("new", shape.key, shape.after_header).alias("after"),
        _fields(shape).alias("fields"),
    )


def diff_findings(
    before: DataFrame, after: DataFrame, key: str, max_findings: int = 500
) -> DataFrame:
    """The first findings by key. Text sorts by code point."""
    rows, shape = _classified(before, after, key, ())
    return _images(_first_changes(rows, max_findings), shape)


def _first_changes(rows: DataFrame, max_findings: int) -> DataFrame:
    """Cut first: the record images are built for the reported rows only."""
    if type(max_findings) is not int or max_findings < 0:
        raise ValueError("max_findings must be a nonnegative whole number")
    return rows.filter(F.col("kind") != "unchanged").orderBy(_KEY).limit(max_findings)


def diff_summary(
    before: DataFrame,
    after: DataFrame,
    key: str,
    max_findings: int = 500,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact counts from one aggregation over the join."""
    rows, _ = _classified(before, after, key, by)
    return _totals(rows, F.col("old").isNotNull(), F.col("new").isNotNull(), by, max_findings)


def _totals(rows: DataFrame, in_before: Column, in_after: Column, by: Sequence[str], max_findings: int) -> DataFrame:
    totals = rows.groupBy(*by).agg(
        F.count_if(in_before).alias("before_rows"),
        F.count_if(in_after).alias("after_rows"),
        *[F.count_if(F.col("kind") == name).alias(name) for name in KINDS],
    )
    total = F.col("added") + F.col("removed") + F.col("changed")
    return totals.select("*", total.alias("total_changes")).select(
        "*",
        F.least("total_changes", F.lit(max_findings).cast("bigint")).alias("reported_findings"),
    )


def diff_status(summary: DataFrame, schema_changes: int) -> DataFrame:
    """``changed`` if any record or any column changed."""
    changed = (F.col("total_changes") > 0) | F.lit(schema_changes > 0)
    return summary.select("*", F.when(changed, "changed").otherwise("unchanged").alias("status"))


def cell_changes(
    before: DataFrame, after: DataFrame, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Long form: one row per finding and field, with both values.

    A finding without any field still yields one row, with a NULL field.
    """
    return _cells(*_classified(before, after, key, by))


def _cells(rows: DataFrame, shape: Shape) -> DataFrame:
    by = shape.by
    every = sorted({*shape.before, *shape.after})
    none = F.lit(None).cast("string")

    def cell(field: str) -> Column:
        old = _old(field).cast("string") if field in shape.before else none
        new = _new(field).cast("string") if field in shape.after else none
        about = F.lit(False)
        if field in shape.after:
            about = about | (F.col("kind") == "added")
        if field in shape.before:
            about = about | (F.col("kind") == "removed")
        if field in shape.shared:
            about = about | ((F.col("kind") == "changed") & _differs(field))
        entry = F.struct(F.lit(field).alias("field"), old.alias("before"), new.alias("after"))
        return F.when(about, entry)

    record = F.when(
        ((F.col("kind") == "added") & F.lit(not shape.after))
        | ((F.col("kind") == "removed") & F.lit(not shape.before)),
        F.struct(none.alias("field"), none.alias("before"), none.alias("after")),
    )
    cells = F.array(*[cell(field) for field in every], record)
    changed = rows.filter(F.col("kind") != "unchanged")
    long = changed.select(*by, F.col(_KEY).alias("key"), "kind", F.explode(cells).alias("cell"))
    return long.filter(F.col("cell").isNotNull()).select(*by, "key", "kind", "cell.*")


# --- all results of one comparison ----------------------------------------------


def _digest(shape: Shape, df: DataFrame, other: DataFrame) -> Column:
    """128 bits of the shared fields, alike on both sides where values are equal."""
    kinds = dict(df.dtypes), dict(other.dtypes)
    values = []
    for field in shape.shared:
        value = F.col(_ticked(field))
        if kinds[0][field] != kinds[1][field]:
            value = F.coalesce(value, F.lit(None).cast(kinds[1][field]))  # the type both are compared in
        values.append(value)
    # Hashes pass over NULLs, so where they are is hashed as well.
    blanks = F.concat(F.lit("b"), *[F.when(value.isNull(), "1").otherwise("0") for value in values])
    return F.struct(F.xxhash64(blanks, *values).alias("a"), F.xxhash64(F.lit("second"), *values, blanks).alias("b"))


def _kinds(before: DataFrame, after: DataFrame, shape: Shape) -> DataFrame:
    """Every key with its kind; only keys and digests are shuffled."""

    def side(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        key = _matched(F.col(_ticked(shape.key))).alias(_KEY)
        return df.select(*shape.by, key, _digest(shape, df, other).alias(name))

    both = side(before, after, "old").join(side(after, before, "new"), [*shape.by, _KEY], "full_outer")
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "changed")
        .otherwise("unchanged")
    )
    return both.select(*shape.by, _KEY, kind.alias("kind"))


@dataclass(frozen=True)
class Comparison:
    """One comparison, written: the kind of every key (``kinds``), and the records of
    both sides where they differ (``changes``)."""

    shape: Shape
    kinds: DataFrame
    changes: DataFrame

    def summary(self, max_findings: int = 500) -> DataFrame:
        return _totals(self.kinds, F.col("kind") != "added", F.col("kind") != "removed", self.shape.by, max_findings)

    def images(self) -> DataFrame:
        return _images(self.changes, self.shape)

    def findings(self, max_findings: int = 500) -> DataFrame:
        return _images(_first_changes(self.changes, max_findings), self.shape)

    def cells(self) -> DataFrame:
        return _cells(self.changes, self.shape)


def compared(before: DataFrame, after: DataFrame, key: str, by: Sequence[str] = ()) -> Comparison:
    """Compare once, for all results. Keys must meet the contract; see ``check_key``."""
    shape = _shape(before, after, key, by)
    kinds = written(_kinds(before, after, shape), "kinds")
    keys = [*shape.by, _KEY]
    differing = kinds.filter(F.col("kind") != "unchanged")

    def fetched(df: DataFrame, fields: Sequence[str], name: str, other_kind: str) -> DataFrame:
        wanted = differing.filter(F.col("kind") != other_kind).select(*keys)
        return _side(df, shape, fields, name).join(wanted, keys, "left_semi")

    old = fetched(before, shape.before, "old", "added")
    new = fetched(after, shape.after, "new", "removed")
    changes = differing.join(old, keys, "left").join(new, keys, "left")
    return Comparison(shape, kinds, written(changes, "changes"))


def compare(
    before: DataFrame, after: DataFrame, key: str, max_findings: int = 500, checked: bool = False
) -> DiffResult:
    """Compare two snapshots after checking their key (``checked``: it has been)."""
    if not checked:
        check_key(before, after, key)
    changes = len(set(header(before)) ^ set(header(after)))
    found = compared(before, after, key)
    return DiffResult(
        summary=diff_status(found.summary(max_findings), changes),
        schema_diff=schema_diff(before, after),
        findings=found.findings(max_findings),
        cells=found.cells(),
    )
