"""Checks that stored results and inputs are what they were."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The checks one verification consists of.
CHECKS = ("source_identity", "result_schema", "summary_counts", "engine_recomputation")


def recompute_equal(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """How many rows only one side has, counting repeats. One aggregation over
    both sides, combined before its shuffle."""
    columns = stored.columns
    sides = stored.select(*columns, F.lit(1).alias("__n")).unionByName(
        fresh.select(*columns, F.lit(-1).alias("__n"))
    )
    balance = sides.groupBy(*columns).agg(F.sum("__n").alias("n"))
    zero = F.lit(0).cast("bigint")
    return balance.agg(
        F.coalesce(F.sum(F.greatest("n", zero)), zero).alias("only_stored"),
        F.coalesce(F.sum(F.greatest(-F.col("n"), zero)), zero).alias("only_fresh"),
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free identity of a table: row count, and two folds of row hashes.

    The hash passes over NULLs, so it also takes where they are.
    """
    columns = [F.col(f"`{name}`") for name in df.columns]
    blanks = F.concat(*[F.when(column.isNull(), "1").otherwise("0") for column in columns])
    row = F.xxhash64(*columns, blanks)
    # Twenty bits per row keep the sum in range up to 2**43 rows.
    low = F.sum(F.pmod(row, F.lit(2**20)))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(row), F.lit(0).cast("bigint")).alias("mixed"),
        F.coalesce(low, F.lit(0).cast("bigint")).alias("total"),
    )


_SUMS = ("s0", "s1", "s2", "s3")
FAN = 16


def block_fingerprints(df: DataFrame, block: Column) -> DataFrame:
    """``block, rows, s0 .. s3``: the order-free identity of every block of a table.

    Two 64-bit hashes of every row are added up by halves, so 128 bits of each row
    count, repeats too. One aggregation, combined before its shuffle; a block may have
    2**31 rows. ``block`` should be a whole number from 0 on, such as a range of record
    numbers or a hash of the key.
    """
    columns = [F.col(f"`{name}`") for name in df.columns]
    blanks = F.concat(F.lit("b"), *[F.when(column.isNull(), "1").otherwise("0") for column in columns])
    hashes = (F.xxhash64(blanks, *columns), F.xxhash64(F.lit("second"), *columns, blanks))
    halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    sums = [F.sum(half).cast("decimal(38,0)").alias(name) for half, name in zip(halves, _SUMS, strict=True)]
    return df.groupBy(block.cast("bigint").alias("block")).agg(F.count(F.lit(1)).alias("rows"), *sums)


def fingerprint_tree(blocks: DataFrame, levels: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """``level, node, rows, s0 .. s3``: blocks (level 0) and what ``FAN`` nodes of a
    level add up to, above; one tree for each value of ``by``. The last level is one
    node, the table. Sums of sums are sums, so all levels come from one aggregation of
    the blocks."""
    nodes = [F.floor(F.col("block") / FAN**level).cast("bigint") for level in range(levels)] + [F.lit(0).cast("bigint")]
    places = F.array(*[F.struct(F.lit(level).alias("level"), node.alias("node")) for level, node in enumerate(nodes)])
    rows = blocks.select(*by, F.explode(places).alias("at"), "rows", *_SUMS).select(*by, "at.*", "rows", *_SUMS)
    sums = [F.sum(name).cast("decimal(38,0)").alias(name) for name in _SUMS]
    return rows.groupBy(*by, "level", "node").agg(F.sum("rows").alias("rows"), *sums)


def drifted_nodes(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes of two trees that differ: ``level, node, rows_before, rows_after``. A
    node that one side lacks has NULL rows there. None at the top means no drift."""
    keys = [*by, "level", "node"]
    old = before.select(*keys, F.col("rows").alias("rows_before"), F.struct("rows", *_SUMS).alias("was"))
    new = after.select(*keys, F.col("rows").alias("rows_after"), F.struct("rows", *_SUMS).alias("is"))
    both = old.join(new, keys, "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("is"))).select(*keys, "rows_before", "rows_after")


def input_drift(receipts: DataFrame, current: DataFrame) -> DataFrame:
    """Inputs whose content changed or vanished since they were received; both
    sides are ``(path, sha256)``.

    A path may stand in several rows. A receipt is sound if its content still is at its
    path, whatever else is there; each unsound receipt is one row.
    """
    versions = current.select(F.col("path").alias("__at"), F.col("sha256").alias("__now")).distinct()
    versions = versions.withColumn("__same", F.lit(True))
    places = current.select(F.col("path").alias("__place")).distinct().withColumn("__there", F.lit(True))
    same = F.col("path").eqNullSafe(F.col("__at")) & F.col("sha256").eqNullSafe(F.col("__now"))
    unsound = receipts.join(versions, same, "left").filter(F.col("__same").isNull())
    joined = unsound.join(places, F.col("path").eqNullSafe(F.col("__place")), "left")
    problem = F.when(F.col("__there").isNull(), "missing").otherwise("changed")
    return joined.select("path", problem.alias("problem"))


def verification_checks(
    stored: DataFrame, fresh: DataFrame, stored_summary: DataFrame, fresh_summary: DataFrame, drift: DataFrame
) -> DataFrame:
    """One row per check with the number of violations and whether it passed."""
    same_schema = stored.dtypes == fresh.dtypes and stored_summary.dtypes == fresh_summary.dtypes
    differing = F.col("only_stored") + F.col("only_fresh")

    def row(df: DataFrame, check: str, violations: Column) -> DataFrame:
        return df.agg(violations.cast("bigint").alias("violations")).select(
            F.lit(check).alias("check"), "violations"
        )

    mismatches = 0 if same_schema else 1
    parts = [
        row(drift, CHECKS[0], F.count(F.lit(1))),
        row(stored_summary, CHECKS[1], F.max(F.lit(mismatches))),
        row(recompute_equal(stored_summary, fresh_summary), CHECKS[2], F.sum(differing)),
        row(recompute_equal(stored, fresh), CHECKS[3], F.sum(differing)),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("*", (F.col("violations") == 0).alias("passed"))


QUALITY_INVARIANTS = {
    "affected_within_rows": "affected_rows <= rows",
    "reported_within_issues": "reported_findings <= issues",
    "affected_within_issues": "affected_rows <= issues",
}
CHANGE_INVARIANTS = {
    "after_rows_add_up": "added + changed + unchanged = after_rows",
    "before_rows_add_up": "removed + changed + unchanged = before_rows",
    "changes_add_up": "added + removed + changed = total_changes",
    "reported_within_changes": "reported_findings <= total_changes",
}


def count_invariants(summaries: DataFrame, invariants: Mapping[str, str]) -> DataFrame:
    """Violations of each invariant over all summaries."""
    counted = summaries.agg(
        *[F.count_if(~F.expr(f"({condition})")).alias(name) for name, condition in invariants.items()]
    )
    entries = F.array(
        *[F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in invariants]
    )
    return counted.select(F.explode(entries).alias("e")).select("e.*")
